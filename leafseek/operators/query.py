"""Queries: what the user wrote, as phrases and terms with a mode."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from ..errors import USAGE, LeafseekError
from ..functions.normalize import normalize_text, token_text

#: A quoted part, or a stretch of other characters up to white space or the next quoted part.
_PART = re.compile(r'"(?P<quoted>[^"]+)"|(?P<bare>(?:(?!"[^"]+")\S)+)')


@dataclass(frozen=True)
class QuerySpec:
    raw: str
    phrases: tuple[str, ...]
    terms: tuple[str, ...]
    literal: bool = False
    case_sensitive: bool = False
    regex: bool = False

    @property
    def needles(self) -> tuple[str, ...]:
        """What is reported: the phrases if there are any, else the terms; the whole query if literal."""
        if self.literal:
            return (self.raw if self.case_sensitive else normalize_text(self.raw),)
        return self.phrases or self.terms

    @property
    def token_phrases(self) -> tuple[str, ...]:
        """What a candidate page must hold, as strings of tokens; an empty one matches nothing."""
        return tuple(token_text(x if not self.case_sensitive else normalize_text(x)) for x in (*self.phrases, *self.terms))


def compiled(pattern: str):
    """A pattern that will be looked for; a bad one is the user's mistake, also where no page is read."""
    try:
        return regex.compile(pattern)
    except regex.error as error:
        raise LeafseekError(USAGE, "search", pattern, f"the pattern cannot be read: {error}", "correct it, or search for it as a literal") from error


def parse_query(raw: str, literal: bool = False, case_sensitive: bool = False, regex_mode: bool = False) -> QuerySpec:
    """Quoted parts become phrases, all other words terms; parts that normalize to nothing go."""
    asked = str(raw).strip()
    parts: dict[str, list[str]] = {"quoted": [], "bare": []}
    for part in _PART.finditer(asked):
        if normal := normalize_text(part[part.lastgroup], casefold=not case_sensitive):
            parts[part.lastgroup].append(normal)
    if regex_mode and asked:
        compiled(asked)
    elif not any(parts.values()):
        raise LeafseekError(USAGE, "search", asked, "there is nothing to look for" if asked else "the query is blank", "give at least a word")
    return QuerySpec(asked, tuple(parts["quoted"]), tuple(parts["bare"]), bool(literal), bool(case_sensitive), bool(regex_mode))


def quoted(term: str) -> str:
    return '"' + term.replace('"', '""') + '"'


def match_expression(spec: QuerySpec) -> str:
    """The candidate condition in words, for explanations."""
    return " AND ".join(map(quoted, (*spec.phrases, *spec.terms)))

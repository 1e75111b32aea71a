"""Failures with stable codes, and their envelope."""

from __future__ import annotations

import json
from dataclasses import dataclass

# Process exit codes and their names.
SUCCESS, USAGE, INPUT, PARSE, INDEX, INTERNAL = 0, 2, 3, 4, 5, 10
CODE_NAMES = {SUCCESS: "Success", USAGE: "UsageError", INPUT: "InputError", PARSE: "ParseError", INDEX: "IndexError", INTERNAL: "InternalError"}


@dataclass
class LeafseekError(Exception):
    """An expected failure: what was done to what, what went wrong, and what helps."""

    code: int
    action: str
    target: str
    message: str
    recovery: str = ""

    def __str__(self) -> str:
        where = f" for {json.dumps(self.target, ensure_ascii=False)}" if self.target else ""
        return f"{self.action} failed{where}: {self.message}" + (f". {self.recovery}" if self.recovery else "")


def error_code_name(code: int) -> str:
    return CODE_NAMES.get(int(code), "UnknownError")


def error_dict(error: LeafseekError) -> dict:
    return {"schema_version": 1, "code": error_code_name(error.code), "exit_code": error.code, "action": error.action, "target": error.target, "message": error.message, "recovery": error.recovery}

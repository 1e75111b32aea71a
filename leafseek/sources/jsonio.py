"""Deterministic JSON: sorted keys, null for numbers that are not finite."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterable

from ..errors import INTERNAL, LeafseekError


def _plain(value):
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, range)):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (str, int, bool)):
        return value
    raise LeafseekError(INTERNAL, "json", type(value).__name__, "unsupported value")


def json_string(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_json(text: str):
    """Strict: trailing data, NaN and malformed text raise ValueError."""

    def refuse(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, parse_constant=refuse)


def read_json(path: str):
    with open(path, encoding="utf-8") as f:
        return parse_json(f.read())


def write_json(path: str, value) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json_string(value) + "\n")
    return path


def atomic_json_write(path: str, value) -> str:
    """Readers see the old file or the new one, never a part."""
    write_json(path + ".tmp", value)
    os.replace(path + ".tmp", path)
    return path


def write_jsonl(path: str, values: Iterable) -> str:
    with open(path, "w", encoding="utf-8") as f:
        for value in values:
            f.write(json_string(value) + "\n")
    return path


def read_jsonl(path: str) -> list:
    with open(path, encoding="utf-8") as f:
        return [parse_json(line) for line in f if line.strip()]

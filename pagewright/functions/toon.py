"""A compact text form of results: nested keys by indent, uniform rows as a table under one header."""

from __future__ import annotations

import json
import re

PLAIN = re.compile(r"^[A-Za-z_][\w .-]*$")
KEYWORDS = ("true", "false", "null")


def scalar(value, delimiter: str = ",") -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return json.dumps(value)
    text = str(value)
    return text if PLAIN.match(text) and text == text.strip() and text not in KEYWORDS and delimiter not in text else json.dumps(text, ensure_ascii=False)


def is_table(rows: list) -> bool:
    """Mappings with the same keys and nothing nested."""
    return bool(rows) and all(isinstance(r, dict) and r and list(r) == list(rows[0]) and not any(isinstance(v, (dict, list)) for v in r.values()) for r in rows)


def encode(value, indent: int = 0) -> str:
    pad = "  " * indent
    if isinstance(value, dict):
        return "\n".join(_entry(k, v, indent) for k, v in value.items())
    if isinstance(value, list):
        return _entry("", value, indent)
    return pad + scalar(value)


def _entry(key: str, value, indent: int) -> str:
    pad = "  " * indent
    if isinstance(value, dict):
        return f"{pad}{key}:" + (f"\n{encode(value, indent + 1)}" if value else "")
    if not isinstance(value, list):
        return f"{pad}{key}: {scalar(value)}"
    if is_table(value):
        rows = "\n".join(f"{pad}  {','.join(scalar(v) for v in r.values())}" for r in value)
        return f"{pad}{key}[{len(value)}]{{{','.join(value[0])}}}:\n{rows}"
    if not any(isinstance(v, (dict, list)) for v in value):
        return f"{pad}{key}[{len(value)}]:" + (f" {','.join(scalar(v) for v in value)}" if value else "")
    items = "\n".join(f"{pad}  - {encode(v, indent + 2).lstrip()}" for v in value)
    return f"{pad}{key}[{len(value)}]:\n{items}"

"""Files beside the pages: YAML base files and JSON canvases."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import yaml

from pagewright.functions.frontmatter import strict_load

LIFTED = ("filters", "properties", "views", "formulas")


class Base(NamedTuple):
    error: str | None
    filters: str | None
    properties: str | None
    extra: str | None
    views: list[dict]
    formulas: list[dict]


def compact(value) -> str | None:
    return None if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=str)


def parse_base(text: str) -> Base:
    """A base file's parts as compact JSON; one that can't be read has its error and nothing else."""
    try:
        whole = strict_load(text)
        if whole is None:
            whole = {}
        if not isinstance(whole, dict):
            raise yaml.YAMLError("the file is not a mapping")
    except yaml.YAMLError as error:
        return Base(str(getattr(error, "problem", None) or error), None, None, None, [], [])
    views = [
        {"ord": i, "name": v.get("name"), "type": v.get("type"), "filters": compact(v.get("filters")), "config": compact({k: x for k, x in v.items() if k not in ("name", "type", "filters")} or None)}
        for i, v in enumerate(whole.get("views") or []) if isinstance(v, dict)
    ]
    formulas = [{"ord": i, "name": str(k), "expr": str(v)} for i, (k, v) in enumerate((whole.get("formulas") or {}).items())]
    return Base(None, compact(whole.get("filters")), compact(whole.get("properties")), compact({k: v for k, v in whole.items() if k not in LIFTED} or None), views, formulas)


SLOT = re.compile(rb'"(file|text)"\s*:\s*("(?:[^"\\]|\\.)*")')


def canvas_slots(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(slot, text, start, end) of a canvas's file and text values; offsets in bytes, quotes included."""
    try:
        json.loads(raw)
    except ValueError:
        return []
    return [(m[1].decode(), json.loads(m[2]), m.start(2), m.end(2)) for m in SLOT.finditer(raw)]

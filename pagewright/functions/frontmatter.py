"""Flat frontmatter: keys, values, tags, aliases, wikilinks and faults of a page's YAML head."""

from __future__ import annotations

import re
from typing import NamedTuple

import yaml

KEY_TRIM = "\"'"
BLOCK_HEADER = re.compile(r"^([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?$")
WIKILINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
COMMENT = re.compile(r"\s+#.*$")


class Entry(NamedTuple):
    key: str
    value: str
    line: int
    last: int


def top_key(line: str) -> tuple[str, int] | None:
    """The key that a line opens and its colon: at column 0, no comment, no list item."""
    if line[:1] in (" ", "\t") or line.lstrip().startswith("#") or line.startswith("- ") or line.rstrip() == "-":
        return None
    colon = line.find(":")
    key = line[:colon].strip().strip(KEY_TRIM) if colon >= 0 else ""
    return (key, colon) if key else None


def block_scalar(header: str, lines: list[str]) -> str:
    """The text of a literal or folded block, as YAML's own scanner reads it; none if it doesn't."""
    block = f"block: {header}\n" + "".join(f"{line}\n" for line in lines)
    try:
        return next((t.value for t in yaml.scan(block, yaml.SafeLoader) if isinstance(t, yaml.ScalarToken) and t.style in ("|", ">")), "")
    except yaml.YAMLError:
        return ""


#: What a backslash and one character stand for between double quotes; others stay as they are.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
SINGLE, DOUBLE = re.compile(r"'((?:[^']|'')*)'", re.DOTALL), re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL)


def decode(text: str) -> tuple[str, bool]:
    """A scalar's text and whether it was quoted; quotes that don't match are text."""
    text = text.strip()
    if m := SINGLE.fullmatch(text):
        return m[1].replace("''", "'"), True
    if m := DOUBLE.fullmatch(text):
        return re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[0]), m[1], flags=re.DOTALL), True
    return COMMENT.sub("", text), False


def list_items(text: str) -> list[str]:
    """Items of a flow list, or of comma-separated text."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    return [x for x in (decode(part)[0].strip() for part in text.split(",")) if x]


def value_of(lines: list[str], remainder: str) -> str:
    """The value as the property table holds it: block text, unquoted scalar, joined flow or block list."""
    if BLOCK_HEADER.match(remainder):
        return block_scalar(remainder, lines)
    if remainder.startswith("[") and not remainder.rstrip().endswith("]"):
        for line in lines:
            remainder += f" {line.strip()}"
            if line.rstrip().endswith("]"):
                break
        return remainder
    if remainder:
        return decode(remainder)[0]
    filled = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    if filled and filled[0].lstrip().startswith("["):
        return value_of(filled[1:], filled[0].strip())
    items = []
    for line in filled:
        trimmed = line.strip()
        if not (trimmed.startswith("- ") or trimmed == "-"):
            break
        items.append(decode(trimmed[1:])[0].strip())
    return f"[{', '.join(items)}]" if items else ""


def entries(block: str) -> list[Entry]:
    """The first entry of each key, with its first and last line in the block."""
    lines = block.splitlines()
    opened = [(i, found) for i, line in enumerate(lines) if line.strip() not in ("", "---") and (found := top_key(line))]
    out, seen = [], set()
    for n, (i, (key, colon)) in enumerate(opened):
        if key in seen:
            continue
        seen.add(key)
        after = opened[n + 1][0] if n + 1 < len(opened) else len(lines) - 1
        last = after - 1
        while last > i and not lines[last].strip():
            last -= 1
        out.append(Entry(key, value_of(lines[i + 1 : after], lines[i][colon + 1 :].strip()), i, last))
    return out


def tags(found: list[Entry]) -> list[tuple[str, str]]:
    """(key, tag) of the tag and tags entries, case kept, marks and quotes stripped."""
    return [(e.key, tag) for e in found if e.key in ("tag", "tags") for item in list_items(e.value) if (tag := item.strip().lstrip("#").strip())]


def aliases(found: list[Entry]) -> list[str]:
    return [x.lower() for e in found if e.key in ("alias", "aliases") for x in list_items(e.value)]


def caps(text: str) -> list[str]:
    return [x for x in re.split(r"[,\s]+", text.strip("[]")) if x]


def wikilinks(block: str, found: list[Entry]) -> list[tuple[str, str]]:
    """(key, target text) of the wikilinks in each entry's lines, in order."""
    lines = block.splitlines()
    return [(e.key, m[1]) for e in found for line in lines[e.line : e.last + 1] for m in WIKILINK.finditer(line)]


class _Strict(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """Refuses a key that occurs twice."""


def _mapping(loader: _Strict, node: yaml.MappingNode, deep: bool = False):
    seen = set()
    for key, _ in node.value:
        name = loader.construct_object(key, deep=True)
        if not isinstance(name, (str, int, float, bool, type(None))) or name in seen:
            raise yaml.constructor.ConstructorError(None, None, f"repeated or unusable key {name!r}", key.start_mark)
        seen.add(name)
    return yaml.SafeLoader.construct_mapping(loader, node, deep)


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def strict_load(text: str):
    """YAML with repeated keys refused."""
    return yaml.load(text, _Strict)


def fault(inner: str) -> tuple[int, str] | None:
    """(line in the file, message) where the head isn't YAML with a mapping at its top."""
    try:
        if not isinstance(strict_load(inner), (dict, type(None))):
            return 2, "frontmatter is not a mapping"
    except yaml.YAMLError as error:
        mark = getattr(error, "problem_mark", None)
        n = inner.count("\n") + 1
        return (min(mark.line, n) + 2 if mark else 2), str(getattr(error, "problem", None) or error).split("\n")[0]
    return None


def typed(value: str | None) -> str:
    """The type a property's text reads as: null, bool, int, float, timestamp, list, nested or text."""
    if value is None or value.strip() in ("", "~", "null", "Null", "NULL"):
        return "null"
    text = value.strip()
    if text in ("true", "false", "True", "False", "TRUE", "FALSE"):
        return "bool"
    if re.fullmatch(r"[+-]?\d+", text):
        return "int"
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", text):
        return "float"
    if re.fullmatch(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?", text):
        return "timestamp"
    if text.startswith("["):
        return "list"
    return "nested" if text.startswith("{") else "text"

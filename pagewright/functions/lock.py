"""The pin block of a page: a fenced block in a strict form, and the fingerprints its pins carry."""

from __future__ import annotations

import re
from typing import NamedTuple

from pagewright.functions.blake3 import hex_digest

#: First word of the block's info string.
LANGUAGE = "page-lock"
VERSION = 2
# Fixed values of the fingerprint format.
SPAN_PREFIX, PROPERTY_PREFIX = "fp1.span2.b3.", "fp1.props1.b3."
TOKEN = re.compile(r"^([a-z0-9]+)\.([a-z0-9]+)\.([a-z0-9]+)\.([0-9a-f]+)$")
PROPERTY_DOMAIN = "props1\n"
FIELD = re.compile(r'^(  - |    )([a-z_]+): (.*)$')
TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"')


class LockError(ValueError):
    """A block that isn't in the strict form."""


class Pin(NamedTuple):
    object: str
    arm: str
    selector: tuple[str, ...]
    fingerprint: str
    hash: str


def texts(value: str, line: int) -> tuple[str, ...]:
    if not (value.startswith("[") and value.endswith("]")) or re.sub(r"[\s,]", "", TEXT.sub("", value[1:-1])):
        raise LockError(f"malformed at line {line}: expected a list of quoted texts")
    return tuple(m.replace('\\"', '"').replace("\\\\", "\\") for m in TEXT.findall(value))


def parse(block: str) -> list[Pin]:
    """The pins of a block, fences included."""
    lines = block.splitlines()
    if len(lines) < 3 or lines[0].strip("`~").split()[:1] != [LANGUAGE]:
        raise LockError("not a lock block")
    if lines[1] != f"version: {VERSION}":
        raise LockError(f"unsupported version at line 2: {lines[1]}")
    if lines[2] not in ("pins:", "pins: []"):
        raise LockError("malformed at line 3: expected pins")
    rows: list[tuple[int, dict[str, str]]] = []
    for number, line in enumerate(lines[3:-1], 4):
        m = FIELD.match(line)
        if not m or (m[1] == "    " and not rows):
            raise LockError(f"malformed at line {number}: expected a pin's field")
        if m[1] == "  - ":
            rows.append((number, {}))
        if m[2] in rows[-1][1]:
            raise LockError(f"malformed at line {number}: {m[2]} occurs twice")
        rows[-1][1][m[2]] = m[3]
    pins = []
    for number, row in rows:
        for field in ("object", "hash", "fingerprint"):
            if not TEXT.fullmatch(row.get(field, "")):
                raise LockError(f"malformed at line {number}: {field} is missing or not quoted")
        target = row["object"][1:-1]
        if not re.fullmatch(r"\[\[[^\[\]]+\]\]", target):
            raise LockError(f"malformed object at line {number}: expected a [[wiki link]]")
        arms = [a for a in ("path", "properties") if a in row]
        if len(arms) != 1:
            raise LockError(f"malformed at line {number}: expected path or properties")
        selector = texts(row[arms[0]], number)
        if arms[0] == "properties" and len(set(selector)) < len(selector):
            raise LockError(f"duplicate properties selector key at line {number}")
        pins.append(Pin(target[2:-2], arms[0], selector, row["fingerprint"][1:-1], row["hash"][1:-1]))
    return pins


def render(pins: list[Pin]) -> str:
    """The block in its one form."""
    quoted = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = [f"```{LANGUAGE}", f"version: {VERSION}", "pins:"]
    for p in pins:
        out += [f"  - object: {quoted(f'[[{p.object}]]')}", f"    hash: {quoted(p.hash)}", f"    {p.arm}: [{', '.join(map(quoted, p.selector))}]", f"    fingerprint: {quoted(p.fingerprint)}"]
    return "\n".join([*out, "```"])


def span_fingerprint(normalised: bytes) -> str:
    if not normalised:
        raise ValueError("an empty span has no fingerprint")
    return SPAN_PREFIX + hex_digest(normalised)


def property_bytes(entries: dict[str, str], keys: list[str]) -> bytes:
    """Sorted, length-prefixed properties; absent, null and text are three states. No keys means all."""
    out = PROPERTY_DOMAIN
    for key in sorted(keys or entries, key=str.encode):
        value = entries.get(key)
        state = "A" if value is None else "N" if value in ("", "~", "null") else f"S{len(value.encode())}:{value}"
        out += f"{len(key.encode())}:{key}={state}\n"
    return out.encode()


def property_fingerprint(entries: dict[str, str], keys: list[str]) -> str:
    return PROPERTY_PREFIX + hex_digest(property_bytes(entries, keys))


def token_class(token: str) -> str:
    """span, properties, unverifiable or malformed."""
    m = TOKEN.match(token)
    if not m:
        return "malformed"
    known = {("fp1", "span2", "b3"): "span", ("fp1", "props1", "b3"): "properties"}.get((m[1], m[2], m[3]))
    return ("malformed" if len(m[4]) != 64 else known) if known else "unverifiable"

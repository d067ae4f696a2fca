from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import frontmatter as fm
from pagewright.functions import linediff, lock, markdown
from pagewright.functions.side_files import canvas_slots, parse_base
from pagewright.functions.toon import encode

PAGE = """---
title: Plan
tags: [a, "#b"]
aliases:
  - My Plan
note: |
  one
  two
up: "[[roadmap]]"
---
pre [[x|y]] `[[no]]`

# Goals ^g1
intro ![[img.png]] %%c [[inc]]%%
- [ ] task one [[a#H]]
  - [x] nested
1. [X] num

## Sub
> [!note]- hi
> body [[b#^blk]]

```py
[[nope]] ^z
```

| a | b |
|---|---|
| [[t\\|al]] | c |

## Sub
end ^tail
"""


def kinds(text):
    return [n.kind for n in markdown.parse(text.encode())]


def test_kinds_and_spans():
    raw = PAGE.encode()
    nodes = markdown.parse(raw)
    assert [n.kind for n in nodes].count("wikilink") == 5
    assert {raw[n.start : n.end].decode() for n in nodes if n.kind in ("embed", "comment", "anchor")} == {"![[img.png]]", "%%c [[inc]]%%", "^g1", "^tail"}
    assert [(n.flag, n.depth) for n in nodes if n.kind == "task"] == [(False, 1), (True, 2), (True, 1)]
    table_link = next(n for n in nodes if n.text == "t")
    assert table_link.alias == "al"
    assert [(n.text, n.alias) for n in nodes if n.kind == "callout"] == [("note", "-")]


def test_sections_and_bodies():
    raw = PAGE.encode()
    found = markdown.sections(raw, markdown.parse(raw))
    assert [(s.heading, s.level, s.n, s.parent) for s in found] == [("Goals ^g1", 1, None, None), ("Sub", 2, 1, 0), ("Sub", 2, 2, 0)]
    assert found[2].hpath == '[{"h":"Goals ^g1"},{"h":"Sub","n":2}]'
    chunks = markdown.bodies(raw, found, markdown.head_end(raw))
    assert chunks[0][:2] == (0, None) and raw[chunks[0][2] : chunks[0][3]].startswith(b"pre ")


def test_chunks_and_headings_make_up_the_page():
    raw = PAGE.encode()
    found = markdown.sections(raw, markdown.parse(raw))
    spans = [(0, markdown.head_end(raw))] + [(a, b) for _, _, a, b in markdown.bodies(raw, found, markdown.head_end(raw))] + [(s.start, s.content) for s in found]
    assert b"".join(raw[a:b] for a, b in sorted(spans)) == raw


def test_heads_only_at_the_start():
    assert kinds("---\na: 1\n---\n") == ["frontmatter"]
    assert "frontmatter" not in kinds("\n---\na: 1\n---\n") + kinds("---\na: 1\n") + kinds("﻿---\na: 1\n---\n")


def test_what_is_no_heading():
    assert kinds("####### seven\n    # code\n\\# no\n#tag\nText\n====\n") == []
    assert kinds("# a\n### b ##\n") == ["heading", "heading"]


def test_fences():
    assert [n.flag for n in markdown.parse(b"~~~\nx\n```\n")] == [True]
    assert [n.flag for n in markdown.parse(b"````md\n```\n````\n# h\n") if n.kind == "fence"] == [False]


def test_anchors():
    assert kinds("a ^b-1\nc^d\ne ^f_g\n^own\n`^no` x\n") .count("anchor") == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="#-[]|`>!^%~ \n\tab:x1é", max_size=120))
def test_any_text_parses_within_its_bytes(text):
    raw = text.encode()
    nodes = markdown.parse(raw)
    assert all(0 <= n.start < n.end <= len(raw) for n in nodes)
    assert [(n.start, -n.end) for n in nodes] == sorted((n.start, -n.end) for n in nodes)
    found = markdown.sections(raw, nodes)
    assert all(s.start <= s.content <= s.chunk_end <= s.end for s in found)


def test_property_values():
    _, block, entries = markdown.page_head(PAGE.encode())
    assert {e.key: e.value for e in entries} == {"title": "Plan", "tags": '[a, "#b"]', "aliases": "[My Plan]", "note": "one\ntwo\n", "up": "[[roadmap]]"}
    assert fm.tags(entries) == [("tags", "a"), ("tags", "b")]
    assert fm.aliases(entries) == ["my plan"]
    assert fm.wikilinks(block, entries) == [("up", "roadmap")]


def test_scalars_and_types():
    assert [fm.decode(x) for x in ("'it''s'", '"a\\nb"', "plain # note")] == [("it's", True), ("a\nb", True), ("plain", False)]
    assert [fm.typed(x) for x in (None, "true", "3", "3.5", "2024-01-02", "[a]", "{}", "x")] == ["null", "bool", "int", "float", "timestamp", "list", "nested", "text"]
    assert fm.entries("---\nk: >-\n  a\n  b\n---\n")[0].value == "a b"


def test_faults():
    assert fm.fault("a: 1\nb: 2\n") is None
    assert fm.fault("a: 1\na: 2\n")[0] == 3
    assert fm.fault("- x\n")[1] == "frontmatter is not a mapping"


def test_norm_takes_out_anchors():
    raw = b"a ^x\n^own\nb\n"
    stays = markdown.without_anchors(raw, markdown.parse(raw))
    assert markdown.kept_bytes(raw, 0, len(raw), stays) == b"a\nb\n"


def test_locks():
    pins = [lock.Pin("notes", "path", ("A", 'b"c'), lock.span_fingerprint(b"x"), "13c"), lock.Pin("p", "properties", (), lock.property_fingerprint({"a": "1"}, []), "0")]
    assert lock.parse(lock.render(pins)) == pins
    assert lock.token_class(pins[0].fingerprint) == "span" and lock.token_class("fp1.span2.b3.zz") == "malformed" and lock.token_class("fp2.x.y.aa") == "unverifiable"
    for broken in (lock.render(pins).replace("version: 2", "version: 1"), lock.render(pins).replace("[[notes]]", "notes"), lock.render(pins) .replace('    hash: "13c"\n', "")):
        try:
            lock.parse(broken)
        except lock.LockError:
            continue
        raise AssertionError(broken)
    assert lock.property_bytes({"a": "", "b": "1"}, ["b", "a", "c"]) == b"props1\n1:a=N\n1:b=S1:1\n1:c=A\n"


def test_line_regions():
    assert linediff.regions(list("abcdef"), list("abXdef")) == [(2, 3, 2, 3)]
    assert linediff.regions([], list("ab")) == [(0, 0, 0, 2)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_regions_turn_one_text_into_the_other(a, b):
    out, at = [], 0
    for lo, hi, left, right in linediff.regions(a, b):
        out += a[at:lo] + b[left:right]
        at = hi
    assert out + a[at:] == b


def test_side_files():
    base = parse_base("filters: {and: [x]}\nviews:\n  - type: table\n    name: T\n    order: [a]\nformulas: {f: 1+1}\nmore: 1\n")
    assert (base.filters, base.extra, base.views[0]["config"], base.formulas[0]["expr"]) == ('{"and":["x"]}', '{"more":1}', '{"order":["a"]}', "1+1")
    assert parse_base("a: 1\na: 2\n").error and not parse_base("a: 1\na: 2\n").views
    raw = b'{"nodes":[{"type":"file","file":"a.md"},{"text":"x \\"y"}]}'
    assert [(s, t, raw[a:b]) for s, t, a, b in canvas_slots(raw)] == [("file", "a.md", b'"a.md"'), ("text", 'x "y', b'"x \\"y"')]


def test_toon():
    assert encode({"a": [{"x": 1, "y": "p, q"}], "b": {"c": None}, "d": [1, 2]}) == 'a[1]{x,y}:\n  1,"p, q"\nb:\n  c: null\nd[2]: 1,2'

"""Operators that compare, move or write documents, against brute force and round trips."""

import hashlib
import io
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest import ODD, as_docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import jaccard_join, links, mixing, substring_dedup, token_shards, warc
from pagewright.llm.common import new_folder
from pagewright.llm.shingles import bitmap, common, folded, shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["zeta", "eta", "theta"]) + str(rng.randrange(1000))
    return " ".join(words)


def copies(seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(3, 150)), f"s{i % 3}") for i in range(60)]
    for base in range(12):
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), edited(rng, rows[base][1], rng.randint(0, 4)), "s1"))
    return rows


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def joined(rows, width, percent):
    sets = [shingles(t, width) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "tile", "hot"), [(3, 90, links.TILE, links.HOT_ROWS), (5, 80, 3, 4), (3, 60, 4, links.HOT_ROWS)])
def test_jaccard_components(spark, monkeypatch, width, percent, tile, hot):
    monkeypatch.setattr(links, "TILE", tile)
    monkeypatch.setattr(links, "HOT_ROWS", hot)
    monkeypatch.setattr(links, "SAMPLE", 64 if hot > 64 else 1)
    rows = copies() + ODD
    found = jaccard_join.jaccard_components(as_docs(spark, rows), width, percent)
    assert Counter(tuple(r) for r in found.collect()) == joined(rows, width, percent)


def test_jaccard_without_rows(spark, nothing, odd):
    assert jaccard_join.jaccard_components(nothing).count() == 0
    assert jaccard_join.drop_near_copies(nothing).columns == nothing.columns


def test_one_of_each_group_stays(spark):
    rows = [(1000 + i, t, s) for i, t, s in copies()] + ODD + [(5, "one more text with the id of a copy", "s"), (8, None, "t")]
    kept = jaccard_join.drop_near_copies(as_docs(spark, rows))
    assert kept.columns == as_docs(spark, []).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    unique = [(i, *r[1:]) for i, r in enumerate(rows)]  # each row with an id of its own
    expected = Counter()
    for (row, n, least), _ in joined(unique, 3, 90).items():
        group = [rows[i] for (i, m, other) in joined(unique, 3, 90) if other == least] if n and row == least else [rows[row]] if not n else []
        if group:
            first = min(group, key=lambda r: (r[0] is None, r[0] or 0))
            expected[first[0], first[1]] += 1
    assert Counter(d for d, _ in got.elements()) == Counter(d for d, _ in expected.elements())
    assert got[5, "one more text with the id of a copy"] == 1 and got[8, None] == 1 and sum(got.values()) == sum(expected.values())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.sampled_from([60, 80, 90, 95]), st.randoms(use_true_random=False))
def test_linked_sets_share_a_bucket(size, percent, rng):
    a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
    gone = rng.randint(0, size * (100 - percent) // 100)
    fresh = rng.randint(0, max(0, (100 * (size - gone) - percent * size) // percent))
    b = np.unique(np.concatenate([a[gone:], np.array([rng.getrandbits(64) for _ in range(fresh)], np.uint64)]))
    shared = common(a, b)
    if 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
        assert set(jaccard_join.bucket_keys(a, percent).tolist()) & set(jaccard_join.bucket_keys(b, percent).tolist())
        assert links.may_link(a, b, bitmap(a), bitmap(b), links.Bound(percent))


def test_folded_bitmaps_are_those_of_a_smaller_width():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64))
    flags = np.zeros(128, np.uint8)
    flags[a & np.uint64(127)] = 1
    assert np.array_equal(folded(bitmap(a), 2), np.packbits(flags, bitorder="little").view(np.uint64))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    found = links.components(spark.createDataFrame(edges, "a long, b long"), "chain")
    assert {r.item: r.component for r in found.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def passages(seed=2):
    rng = random.Random(seed)
    shared = [prose(rng, 70).replace("\n", " ") for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(20, 60)).replace("\n", " ") for _ in range(4)]
        if i % 3 == 0:
            parts.insert(rng.randrange(5), edited(rng, shared[i % 4], 1 if i % 2 else 0))
        rows.append((i, "\n".join(parts), "s"))
    return rows, shared


def test_repeated_passages(spark, nothing):
    rows, shared = passages()
    found = substring_dedup.repeated_passages(as_docs(spark, rows + [(200, rows[1][1], "s"), (201, None, "s"), (202, "", "s"), (None, rows[2][1], "s")])).collect()
    planted = {i for i, _, _ in rows if i % 3 == 0}
    assert {r.doc_id for r in found} == planted | {1, 200}
    text = {i: t for i, t, _ in rows} | {200: rows[1][1]}
    for r in found:
        assert text[r.doc_id][r.start : r.end].strip() == text[r.doc_id][r.start : r.end] and r.passage_words >= substring_dedup.LEAST_WORDS
        assert r.kept_doc_id <= r.doc_id
    for group in {r.group_id for r in found}:
        assert sum(not r.removed for r in found if r.group_id == group) <= 1  # none where the kept one's passage is too short
    assert substring_dedup.repeated_passages(nothing).count() == 0
    cut = {r.doc_id: r.text for r in substring_dedup.remove_passages(as_docs(spark, rows)).collect()}
    assert all(cut[i] == text[i] for i, _, _ in rows if i not in planted)
    assert len(planted) - 8 <= sum(len(cut[i]) < len(text[i]) for i in planted) <= len(planted) - 1


def test_long_lines_are_cut_alike():
    rng = random.Random(8)
    shared = prose(rng, 120).replace("\n", " ")
    pieces = lambda before: {shingle_bytes.tobytes() for _, _, shingle_bytes in substring_dedup.paragraphs(f"{before} {shared}".encode(), 5)}
    assert len(pieces(prose(rng, 90).replace("\n", " ")) & pieces(prose(rng, 33).replace("\n", " "))) >= 3


def test_tuned_bands():
    bands, rows = substring_dedup.tuned_bands(0.8, 0.99, 6)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands <= 6


def test_odd_texts_have_no_passages_of_their_own(spark, odd):
    found = {r.doc_id for r in substring_dedup.repeated_passages(odd).collect()}
    assert found == {4, 5}


def test_mix(spark, odd, nothing):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)] + ODD
    planned = mixing.mix_plan(as_docs(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sums = Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sums.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sums[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sums[s] for s in over}
        left -= sum(2 * sums[s] for s in over)
        open_ -= over
    for r in planned:
        assert r.size == size(r.row.text) and r.source_size == sums[r.row.source] and r.target == pytest.approx(target[r.row.source]) and 0 <= r.copies <= 2
    taken = Counter()
    for r in planned:
        taken[r.row.source] += r.copies * r.size
    assert taken["a"] == pytest.approx(target["a"], rel=0.15)
    mixed = mixing.mix_sources(as_docs(spark, rows))
    assert mixed.columns == as_docs(spark, []).columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({d: sum(r.copies for r in planned if r.row.doc_id == d) for d in {r[0] for r in rows}})
    assert mixing.mix_sources(nothing).count() == 0
    assert {r.target for r in mixing.mix_plan(as_docs(spark, [(1, None, "a"), (2, "", "b")])).collect()} == {0.0}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.text(max_size=8))
def test_feistel_is_a_permutation(n, key):
    order = token_shards.Feistel(n, key)
    slots = order.slots(np.arange(n, dtype=np.uint64))
    assert sorted(slots.tolist()) == list(range(n))
    assert np.array_equal(order.inverse(slots), np.arange(n))


def test_token_shards_hold_every_id_in_order(spark, tmp_path, nothing):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 80)), "s") for i in range(50)] + [(60, "two  spaces and \n breaks ", "s")] + ODD
    docs = as_docs(spark, rows).coalesce(3)
    folder = f"file://{tmp_path}/shards"
    written = token_shards.write_shards(docs, folder, length=64, shard_sequences=16).orderBy("slot").collect()
    n = len(written)
    assert [r.slot for r in written] == list(range(n)) and sorted(r.sequence for r in written) == list(range(n))
    read = list(token_shards.read_slots(folder, 0, 64, 16))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read] == [r.payload_sha256 for r in written]
    order = token_shards.Feistel(n, token_shards.KEY)
    assert order.inverse(np.arange(n)).tolist() == [r.sequence for r in written]
    stream = np.concatenate([read[int(order.slots(np.array([i], np.uint64))[0])] for i in range(n)])
    encode = token_shards.encoder(token_shards.RANKS).encode
    expected = [x for r in docs.collect() if r.text for x in [*encode(r.text), token_shards.END_OF_TEXT]]
    assert stream[: len(expected)].tolist() == expected and set(stream[len(expected) :].tolist()) <= {token_shards.END_OF_TEXT}
    assert [x.tolist() for x in token_shards.read_slots(folder, 21, 64, 16)] == [x.tolist() for x in read[21:]]
    assert {d for r in written for d in r.doc_ids} == {r[0] for r in rows if r[1]}
    assert os.path.getsize(f"{tmp_path}/shards/shard-00000000.bin") == 16 * 64 * 2
    assert token_shards.write_shards(nothing).count() == 0


def test_encoder_is_the_librarys():
    rng = random.Random(3)
    e = token_shards.Encoder(token_shards.RANKS)
    texts = ["".join(rng.choice(" \n aé漢's12.,x") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    end = np.array([token_shards.END_OF_TEXT], token_shards.ID).tobytes()
    assert e.texts(texts) == [e.ids(t) + end if t else b"" for t in texts]


def test_encoder_cuts_long_texts_only_where_ids_part(monkeypatch):
    monkeypatch.setattr(token_shards, "STEP", 5)
    rng = random.Random(4)
    texts = ["".join(rng.choice("  \x1c\xa0\n\taé漢's12.,x") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    assert any(len(list(token_shards.pieces(t))) > 2 for t in texts) and all("".join(token_shards.pieces(t)) == t for t in texts)
    e = token_shards.Encoder(token_shards.RANKS)
    assert [x[: -token_shards.ID.itemsize] for x in e.texts(texts)] == [e.ids(t) for t in texts]


def test_encoder_takes_little_more_time_than_the_library():
    rng = random.Random(5)
    e = token_shards.Encoder(token_shards.RANKS)
    shares = []
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 14))) for _ in range(600)) for _ in range(100)]
        start = time.process_time()
        plain = [e.ids(t) for t in texts]
        between = time.process_time()
        found = e.texts(texts)
        shares.append((time.process_time() - between) / (between - start))
        assert [x[: -token_shards.ID.itemsize] for x in found] == plain
    assert min(shares) < 1.3, shares


PAGES = [(3, "u3", "z" * 120), (1, "u1", "z" * 120), (2, "u2", "short"), (4, "u4", "short"), (5, None, None), (6, "a\r\nX: 1", ""), (7, "u7", "é" * 60), (7, "u7", "é" * 60), (8, "u8", "é" * 60), (None, "n", "z" * 120), (9, "u9", "y" * 900_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, member string")
    got = Counter(tuple(r) for r in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    expected = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "").encode() == data and p is not None), default=None)
        again = len(data) >= 100 and first is not None and page != first
        expected[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == expected
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    files = warc.write_archives(pages.coalesce(1), new_folder(spark, "warc-test")).collect()
    assert sum(f.records for f in files) == len(PAGES)
    digest = warc.sha256(b"abc")
    member = warc.pack("response", 1, "u", b"abc", digest)
    two = list(warc.read_records(io.BytesIO(member + warc.pack("response", 2, "v", b"", warc.sha256(b"")))))
    assert [r.headers["warc-target-uri"] for r in two] == ["u", "v"] and warc.http_payload(two[0]) == (3, b"abc")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(member[:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.pack("response", 1, "u", b"abd", digest))))


def between(rng, passage, before, after, gap=" "):
    """A passage inside a line, or over lines, with other words on either side."""
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    return f"{words(before)}{gap}{passage}{gap}{words(after)}"


def span_words(rows, text):
    """Places of the words that rows of a document cover."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    return {i for i, (a, b) in enumerate(at) if any(r.start <= a and b <= r.end for r in rows)}


def test_a_passage_is_found_as_a_line_and_inside_lines(spark):
    rng = random.Random(31)
    rows = []
    for n in range(12):
        line = " ".join(f"p{rng.randrange(10**9)}" for _ in range(51 + n % 10))
        rows += [(10 * n, f"{between(rng, 'x', 2, 2)}\n{line}\nend", "s"), (10 * n + 1, between(rng, line, 80, 90), "s")]
        line = " ".join(f"q{rng.randrange(10**9)}" for _ in range(51))
        rows += [(10 * n + 2, between(rng, line, 6, 6), "s"), (10 * n + 3, between(rng, line, 6, 6), "s")]
    found = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    for i, text, _ in rows:
        words = WORD.findall(text)
        planted = {k for k, w in enumerate(words) if w[0] in "pq"}
        assert span_words([r for r in found if r.doc_id == i], text) == planted


def test_the_ends_of_a_passage_count(spark):
    rng = random.Random(32)
    rows = []
    for n, size in enumerate([25, 30, 40, 51, 51, 55, 60, 64]):
        passage = " ".join(f"p{rng.randrange(10**9)}" + ("\n" if n % 2 and not k % 12 else "") for k in range(size))
        rows += [(10 * n, between(rng, passage, 200 + n, 210), "s"), (10 * n + 1, between(rng, passage, 230, 200 + n), "s")]
    found = substring_dedup.repeated_passages(as_docs(spark, rows)).collect()
    for i, text, _ in rows:
        assert span_words([r for r in found if r.doc_id == i], text) == {k for k, w in enumerate(WORD.findall(text)) if w[0] == "p"}

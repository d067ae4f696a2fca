"""What only shows on larger tables: ties, very wide directories, long graphs."""

import random

import duckdb
from pyspark.sql import functions as F

from pagewright.functions.blake3 import digests, joined
from pagewright.operators import graph, history, merkle, project, relocate, resolve
from pagewright.plans import registry
from pagewright.sources import scratch


def test_max_by_ties_and_nulls(spark, tmp_path):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, i % 7 AS o_custkey, CASE WHEN i % 7 = 6 THEN NULL ELSE CAST(i // 7 % 3 AS DOUBLE) END AS o_totalprice FROM range(2000) t(i)")
    con.sql(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "events"):
        con.sql(f"COPY (SELECT 1 AS k) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    expected = con.sql(registry.ORACLE["sql_agg_max_by"]).fetchall()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = registry.QUERIES["sql_agg_max_by"](spark, str(tmp_path))
        assert sorted(map(tuple, found.select("o_custkey", "top_order", "low_order").collect())) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_directory_is_hashed_in_parts(spark):
    files = [(f"wide/{i * 7919 % 30011}-é{'x' * (i % 150)}.md", f"{i:064x}") for i in range(9000)] + [("wide/sub/a.md", "1" * 64), ("wide/sub/b.md", "2" * 64), ("top.md", "3" * 64)]
    df = spark.createDataFrame(files, "path string, digest string")
    at_once = {r.path: r.digest for r in merkle.directories(df).collect()}
    entries = [(p.split("/")[1].encode(), False, bytes.fromhex(d)) for p, d in files[:9000]]
    sub = digests([merkle.encoded([(b"a.md", False, b"\x11" * 32), (b"b.md", False, b"\x22" * 32)])])[0]
    assert at_once["wide"] == digests([merkle.encoded([*entries, (b"sub", True, sub)])])[0].hex()
    assert len(merkle.encoded(entries)) > 8 * merkle.PART
    # Both limits cross here: `sub` and the top have one part, `wide` has many.
    assert {r.path: r.digest for r in merkle.directories(df, many=1).collect()} == at_once


def test_parts_of_a_message_join_to_its_digest():
    message = bytes(range(256)) * 1500 + b"end"
    for size in (1024, 4096, 65536):
        cut = [message[i : i + size] for i in range(0, len(message), size)]
        assert joined(digests(cut, [i * size // 1024 for i in range(len(cut))])) == digests([message])[0]


def test_names_of_pages_are_those_of_the_whole_parse(spark):
    rng = random.Random(3)
    bits = ["[[a]]", "![[b#h|x]]", "\\", "`", "```\n", "~~~\n", "\n", "\n\n", "    ", "\t", "- ", "> ", "# ", "text ", "[[c\\|d]]", "|", "---\n", "--|--\n", "é", "\r\n"]
    heads = ["", "---\nalias: One, two\n---\n", "---\naliases:\n  - Drei\n", "---\ntype: x\n...\n"]
    raws = ["".join([rng.choice(heads), *rng.choices(bits, k=rng.randrange(15))]) for _ in range(400)] + [None]
    pages = spark.createDataFrame([(f"p{i}.md", raw) for i, raw in enumerate(raws)], "path string, raw string")
    whole = project.parse_pages(pages).select("path", "alias", F.transform("link", lambda x: F.struct(x["seq"], x["target_raw"])).alias("link"))
    found = sorted(map(tuple, project.parse_names(pages).collect()))
    assert found == sorted(map(tuple, whole.collect())) and sum(len(links) for _, _, links in found) > 300


def test_mutual_links_need_no_walk(spark, monkeypatch):
    # Hubs in a long chain, each linked with its own leaves: one round of names per hub before.
    chain = [(f"h{i:03}", f"h{i + 1:03}") for i in range(60)] + [("h060", "end"), ("begin", "h000"), ("begin", "lone"), ("self", "self")]
    leaves = [e for i in range(61) for e in ((f"h{i:03}", f"l{i}"), (f"l{i}", f"h{i:03}"))]
    with monkeypatch.context() as patched:
        patched.setattr(graph, "loops", lambda edges: (_ for _ in ()).throw(AssertionError("walked")))
        found = [r.node for r in graph.cyclic(spark.createDataFrame(chain + leaves, "src string, dst string")).collect()]
    assert sorted(found) == sorted([f"h{i:03}" for i in range(61)] + [f"l{i}" for i in range(61)] + ["self"])


def test_cyclic_on_random_graphs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(15)]
        reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
        for _ in range(14):
            reach = {a: bs.union(*(reach.get(b, set()) for b in bs)) for a, bs in reach.items()}
        assert sorted(r.node for r in graph.cyclic(spark.createDataFrame(edges, "src string, dst string")).collect()) == sorted(a for a, bs in reach.items() if a in bs)


def test_a_move_resolves_what_it_can_change(spark, monkeypatch):
    rng = random.Random(8)
    paths = [f"{d}/{n}.md" for d in "abc" for n in ("one", "two", "three", "four")] + ["five.md", "six.md"]
    targets = ["one", "a/two", "Three.md", "c/four", "five", "Nick", "other", "new", "b/new", "gone", "", "x:one"]
    links = spark.createDataFrame([(rng.choice(paths), i, rng.choice(targets)) for i in range(300)], "src_path string, seq long, target_raw string")
    pages, aliases = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([("six.md", "nick"), ("c/one.md", "other"), ("five.md", "new")], "path string, alias string")
    moves = spark.createDataFrame([("a/one.md", "b/new.md"), ("six.md", "c/six.md"), ("b/three.md", "b/gone.md")], "from_path string, to_path string")
    resolved, plain = [], resolve.resolve
    monkeypatch.setattr(resolve, "resolve", lambda rows, *rest: resolved.append(rows.count()) or plain(rows, *rest))
    plan = lambda: sorted(map(repr, relocate.move_plan(links, pages, aliases, moves).collect()))
    narrow, few = plan(), list(resolved)
    resolved.clear()
    monkeypatch.setattr(relocate, "touched", lambda rows, *_: rows)
    assert plan() == narrow and narrow and resolved == [300, 300] and max(few) < 200


def test_an_append_takes_links_of_unchanged_pages_from_the_log(spark):
    pages = [("a.md", "---\ntype: x\n---\n# A\n[[c]] [[b]]\n"), ("b.md", "x\n"), ("d/c.md", "---\naliases: [q]\n---\n[[a]] [[q]]\n")]
    found = []
    for names_only in (True, False):
        log = history.History(spark, scratch.new_folder(spark, "test-history"), names_only=names_only)
        for n in (2, 3):
            log.sync(spark.createDataFrame(pages[:n], "path string, raw string"))
        assert sorted((r.path, r.gen, r.parsed) for r in log.docs().collect()) == [("a.md", 2, 1), ("b.md", 1, 1), ("d/c.md", 2, 2)]
        found.append(sorted((r.src_path, r.seq, r.target_raw, r.dest_path) for r in log.relation("link").collect()))
    assert found[0] == found[1] == [("a.md", 0, "c", "d/c.md"), ("a.md", 1, "b", "b.md"), ("d/c.md", 0, "a", "a.md"), ("d/c.md", 1, "q", "d/c.md")]
    # The other rows of the page that only was resolved again stay those of its parse.
    assert [(r.path, r.heading) for r in log.relation("section").collect()] == [("a.md", "A")] and log.table("section").count() == 1

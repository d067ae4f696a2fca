import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import frontmatter, lock
from pagewright.functions.blake3 import digests, hex_digest
from pagewright.operators import delta, graph, history, merkle, pins, project, relocate, resolve, rules, views
from pagewright.plans import sql_door
from pagewright.sources import scratch, workspace


def pages(spark, **raws):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in raws.items()], "path string, raw string")


def linked(spark, found):
    return {(r.src_path, r.target_raw): (r.dest_path, r.candidates) for r in views.Workspace(project.parse_pages(found)).link.collect()}


def test_resolution_rules(spark):
    found = pages(
        spark, x__a="# A\n", y__a="# A\n", y__b="[[a]] [[x/a]] [[A.md]] [[z/a]] [[other:a]] [[#H]] [[nick]] [[gone]]\n", long__dir__c="---\naliases: [Nick]\n---\n", d="[[a]]\n"
    )
    got = linked(spark, found)
    assert got["y/b.md", "a"] == ("y/a.md", ["x/a.md", "y/a.md"])
    assert got["d.md", "a"][0] == "x/a.md"
    assert got["y/b.md", "x/a"] == ("x/a.md", None)
    assert got["y/b.md", "A.md"][0] == "y/a.md"
    assert got["y/b.md", "z/a"] == got["y/b.md", "other:a"] == got["y/b.md", "gone"] == (None, None)
    assert got["y/b.md", ""][0] == "y/b.md"
    assert got["y/b.md", "nick"][0] == "long/dir/c.md"


def test_edges_and_backlinks_are_inverse(spark):
    ws = views.Workspace(project.parse_pages(pages(spark, a="[[b]] [[b]] [[no]]\n", b="[[a]]\n", c="x\n")))
    counts = {(r.src_path, r.channel, r.key): r.n for r in resolve.edge_counts(ws.link).collect()}
    assert counts == {("a.md", "resolved", "b.md"): 2, ("a.md", "unresolved", "no"): 1, ("b.md", "resolved", "a.md"): 1}
    rows = {r.src_path: r.asDict() for r in resolve.edge_map(ws.paths, resolve.edge_counts(ws.link)).collect()}
    assert rows["c.md"]["resolved"] == {} and rows["a.md"]["resolved"] == {"b.md": 2}
    assert sorted((r.path, r.src_path) for r in views.backlink(ws.link, ws.frontmatter_link).collect()) == [("a.md", "b.md"), ("b.md", "a.md"), ("b.md", "a.md")]


def test_exclusions(spark):
    dangling = spark.createDataFrame([("a.md", 0, "img/x.png"), ("a.md", 1, "y.base"), ("a.md", 2, "no")], "src_path string, seq long, target_raw string")
    listing = spark.createDataFrame([("img/x.png", "not-markdown"), ("deep/y.base", "not-markdown"), ("y/y.base", "ignored")], "path string, reason string")
    got = {r.seq: (r.exclusion, r.exclusion_path) for r in resolve.exclusions(dangling, listing).collect()}
    assert got == {0: ("not-markdown", "img/x.png"), 1: ("ignored", "y/y.base"), 2: (None, None)}


def test_history_upkeep_equals_a_fresh_build(spark):
    log = history.History(spark, scratch.new_folder(spark, "test-history"))
    first = pages(spark, a="[[b]] [[c]]\n", b="# B\n[[a]]\n", z__b="x\n")
    assert log.freshness(first) == "NO_VIEW"
    assert log.sync(first)["added"] == 3
    assert log.sync(first) is None and log.freshness(first) == "FRESH"
    second = pages(spark, a="[[b]] [[c]]\n", z__b="y [[a]]\n", c="---\naliases: [q]\n---\n")
    assert log.freshness(second) == "STALE"
    pin = log.sync(second)
    assert (pin["gen"], pin["added"], pin["changed"], pin["removed"]) == (2, 1, 1, 1)
    got = sorted((r.src_path, r.target_raw, r.dest_path) for r in log.relation("link").collect())
    fresh = views.Workspace(project.parse_pages(second)).link.collect()
    assert got == sorted((r.src_path, r.target_raw, r.dest_path) for r in fresh)
    assert {r.path for r in log.docs(1).collect()} == {"a.md", "b.md", "z/b.md"}
    assert sorted(r.text for r in log.relation("body").collect()) == ["[[b]] [[c]]\n", "y [[a]]\n"]
    other = log.compacted(scratch.new_folder(spark, "test-history"))
    assert {r.path for r in other.docs().collect()} == {"a.md", "z/b.md", "c.md"} and other.generation() == 2


def test_digest_tree(spark):
    leaf = lambda n: digests([n])[0]
    files = spark.createDataFrame([("d/x.md", leaf(b"1").hex()), ("a.md", leaf(b"2").hex())], "path string, digest string")
    inner = digests([merkle.encoded([(b"x.md", False, leaf(b"1"))])])[0]
    assert merkle.root(files) == "b3:" + hex_digest(merkle.encoded([(b"a.md", False, leaf(b"2")), (b"d", True, inner)]))
    assert merkle.root(files.limit(0)) == "b3:" + hex_digest(b"")
    assert merkle.base_fold([("x.base", None)]) != merkle.base_fold([])


def test_rename_only_when_nothing_else_moved(spark):
    state = lambda *rows: spark.createDataFrame(list(rows), "path string, file_rev string")
    one = delta.file_delta(state(("a", "1"), ("k", "9")), state(("b", "1"), ("k", "9")))
    assert [(r.path, r.change, r.from_path) for r in delta.ruled_delta(one).collect()] == [("b", "renamed", "a")]
    two = delta.file_delta(state(("a", "1"), ("c", "2")), state(("b", "1")))
    assert sorted((r.path, r.change) for r in delta.ruled_delta(two).collect()) == [("a", "deleted"), ("b", "created"), ("c", "deleted")]
    left = delta.ruled_delta(one, spark.createDataFrame([("a",)], "path string"))
    assert sorted((r.path, r.change) for r in left.collect()) == [("a", "unattested"), ("b", "created")]


def test_node_changes():
    before = b"# A\nx\n\n# B\ny\n"
    assert delta.node_changes(before, b"# A\nx ^m\n\n# B\ny\n") == [("anchored", "section", '[{"h":"A"}]')]
    assert delta.node_changes(before, b"# A\nz\n\n# C\ny\n") == [("added", "section", '[{"h":"C"}]'), ("edited", "section", '[{"h":"A"}]'), ("removed", "section", '[{"h":"B"}]')]


def test_replay(spark):
    log = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (5, "x", "y")], "seq long, root_before string, root_after string")
    assert [r.seq for r in delta.replayed(log, "a", "c").orderBy("seq").collect()] == [1, 2]
    assert delta.replayed(log, "a", "y").isEmpty()


def test_walk_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.walk(edges, start, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in graph.cyclic(edges).collect()} == {"a", "b", "c"}
    assert graph.loops(edges.limit(0)).isEmpty()


def test_loops_are_strongly_connected_components(spark):
    between = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("a", "s"), ("y", "z")]
    rng = random.Random(3)
    some = [(f"{rng.randrange(24):02}", f"{rng.randrange(24):02}") for _ in range(34)]
    for rows in (between, some):
        reach = {n: {d for s, d in rows if s == n} for n in {x for row in rows for x in row}}
        while (more := {n: to | {d for t in to for d in reach[t]} for n, to in reach.items()}) != reach:
            reach = more
        expected = {(n, max(m for m in to if n in reach[m])) for n, to in reach.items() if n in to}
        got = [(r.node, r.loop) for r in graph.loops(spark.createDataFrame(rows, "src string, dst string")).collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert {n for n, _ in expected} and graph.loops(spark.createDataFrame(between, "src string, dst string")).where("node IN ('m', 'n')").isEmpty()


def test_pins_and_base_files_in_the_log(spark):
    log = history.History(spark, scratch.new_folder(spark, "test-history"))
    pin = lock.render([lock.Pin("b", "path", ("B",), lock.span_fingerprint(b"# B\n"), "0")])
    bases = lambda *rows: spark.createDataFrame(list(rows), "path string, raw string")
    dest = lambda: [(r.src_path, r.dest_path) for r in log.relation("lock").collect()]
    base = lambda: sorted((r.path, r.gen) for r in log.base().collect())
    view = "views: [{name: V, type: t}]\nformulas: {f: x}\n"
    first = pages(spark, a=f"{pin}\n", b="# B\n", c=f"{pin}\n\n{pin}\n")
    log.sync(first, bases(("v.base", view), ("n.base", None), ("gone.base", "{}")))
    assert dest() == [("a.md", "b.md")] and [r.path for r in log.relation("lock_fault").collect()] == ["c.md"]
    assert [tuple(r) for r in views.referrers(log.relation("lock")).select("path", "src_path", "seq").collect()] == [("b.md", "a.md", 0)]
    assert base() == [("gone.base", 1), ("n.base", 1), ("v.base", 1)]
    # a file that couldn't be read is read again; without base files nothing is said about them
    assert log.sync(first) is None
    assert log.sync(first, bases(("v.base", view), ("n.base", None)))["gen"] == 2
    assert base() == [("n.base", 2), ("v.base", 1)]
    moved = first.where("path <> 'b.md'").union(pages(spark, z__b="# B\n"))
    log.sync(moved)
    assert dest() == [("a.md", "z/b.md")] and base() == [("n.base", 2), ("v.base", 1)]
    stamp = log.stamp().first()
    assert (stamp.gen, stamp.doc_count, stamp.as_of_fingerprint) == (3, 3, log.pins()[-1]["fingerprint"]) and log.stamp(1).first().gen == 1
    other = log.compacted(scratch.new_folder(spark, "test-history"))
    assert [r.name for r in other.relation("base_view").collect()] == ["V"] and [r.expr for r in other.relation("base_formula").collect()] == ["x"]
    assert [(r.src_path, r.dest_path) for r in other.relation("lock").collect()] == [("a.md", "z/b.md")]


def test_links_to_base_files(spark):
    excluded = spark.createDataFrame([("a.md", 0, "d/v.base"), ("a.md", 1, "x.png"), ("b.md", 0, None)], "src_path string, seq long, exclusion_path string")
    found = views.base_embeds(excluded, spark.createDataFrame([("d/v.base",), ("w.base",)], "path string"))
    assert [tuple(r) for r in found.collect()] == [("d/v.base", "a.md", 0)]


def test_moves_and_edits(spark):
    found = pages(spark, a="[[n__x]] see [[x]]\n", n__x="hi\n", m__x="[[x]]\n")
    ws = views.Workspace(project.parse_pages(found))
    moves = spark.createDataFrame([("n/x.md", "n/w.md")], "from_path string, to_path string")
    plan = lambda ws: {(r.src_path, r.target_raw): (r.new_target, r.kind) for r in relocate.move_plan(ws.link.select("src_path", "seq", "target_raw"), ws.paths, ws.aliases, moves).collect()}
    assert plan(ws) == {}, "the link names the other x"
    assert plan(views.Workspace(project.parse_pages(found.where("path <> 'm/x.md'")))) == {("a.md", "x"): ("w", "bare")}
    edits = spark.createDataFrame([("a.md", 0, 2, "<<"), ("a.md", 6, 8, ">>")], "path string, span_start long, span_end long, text string")
    assert {r.path: r.raw for r in relocate.applied(found, edits).collect()}["a.md"] == "<<n__x>> see [[x]]\n"
    assert relocate.overlapping(edits.union(edits)).count() == 2


def test_pins_and_fingerprints(spark):
    pin = lock.render([lock.Pin("b", "path", ("B",), lock.span_fingerprint(b"# B\n"), "0")])
    ws = views.Workspace(project.parse_pages(pages(spark, a=f"{pin}\n", b="# B\n", c=f"{pin}\n\n{pin}\n")))
    assert [(r.src_path, r.object, r.dest_path, r.selector) for r in ws.lock.collect()] == [("a.md", "b", "b.md", '["B"]')]
    assert [(r.path, r.error) for r in ws.lock_fault.collect()] == [("c.md", "more than one lock block on the page")]


def test_nearest_headings(spark):
    asked = spark.createDataFrame([("a", "Result")], "path string, text string")
    offered = spark.createDataFrame([("a", "Results"), ("a", "Notes"), ("a", "Insult")], "path string, heading string")
    assert graph.nearest(asked, offered).first().near[0] == "Results"


def test_sql_rewrites(spark):
    assert "WHERE __qualified" in sql_door.rewritten("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1 ORDER BY a")
    assert sql_door.rewritten("SELECT max(x) FILTER (y = 1) FROM t") == "SELECT max(x) FILTER (WHERE y = 1) FROM t"
    assert sql_door.rewritten("SELECT starts_with(a, 'starts_with(') FROM t") == "SELECT startswith(a, 'starts_with(') FROM t"
    with pytest.raises(sql_door.SqlRefused):
        sql_door.rewritten("DELETE FROM doc")
    spark.range(3).createOrReplaceTempView("three")
    with pytest.raises(sql_door.SqlRefused, match="three: id"):
        sql_door.run(spark, "SELECT nope FROM three")
    framed = sql_door.frame(sql_door.run(spark, "SELECT id, CAST('NaN' AS DOUBLE) AS x, array(1, 2) AS y FROM three ORDER BY id LIMIT 1"), "b3:0", "FRESH")
    assert framed["rows"] == [[0, None, [1, 2]]] and framed["row_count"] == 1 and not framed["truncated"]
    cut = sql_door.frame(sql_door.run(spark, "SELECT id FROM three"), "b3:0", "FRESH", most=2)
    assert cut["row_count"] == 2 and cut["truncated"]


def test_nulls_come_last(spark):
    spark.sql("SELECT * FROM VALUES (1), (NULL), (2) AS t(x)").createOrReplaceTempView("gaps")
    answer = lambda sql: [r.x for r in sql_door.run(spark, sql).collect()]
    assert answer("SELECT x FROM gaps ORDER BY x") == [1, 2, None]
    assert answer("SELECT x FROM gaps ORDER BY x DESC LIMIT 1") == [2]
    assert answer("SELECT x FROM gaps ORDER BY x NULLS FIRST") == [None, 1, 2]
    assert answer("SELECT x FROM (SELECT x, row_number() OVER (ORDER BY abs(x), x) AS n FROM gaps) WHERE n = 3") == [None]
    assert sql_door.rewritten("SELECT a FROM t ORDER BY f(a, b) DESC, 2 LIMIT 3") == "SELECT a FROM t ORDER BY f(a, b) DESC NULLS LAST, 2 NULLS LAST LIMIT 3"


@pytest.mark.parametrize("sql", ["WITH w AS (SELECT 1 AS id) INSERT INTO three SELECT * FROM w", "FROM three INSERT INTO other SELECT *", "LOAD DATA INPATH 'x' INTO TABLE three", "REPLACE TABLE three (id INT)", "SET a.b = 1", "DROP VIEW three"])
def test_writes_are_refused_wherever_they_stand(spark, sql):
    spark.range(3).createOrReplaceTempView("three")
    with pytest.raises(sql_door.SqlRefused):
        sql_door.run(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT rand() FROM doc WHERE path = 'a'", "SELECT current_date() FROM doc WHERE path = 'a'", "SELECT row_number() OVER (ORDER BY path) FROM doc WHERE path = 'a'", "SELECT (SELECT max(path) FROM doc) FROM doc WHERE path = 'a'", "SELECT explode(array(1)) FROM doc WHERE path = 'a'", "SELECT path FROM doc WHERE path = 'a' GROUP BY path"])
def test_provenance_of_more_than_a_row(spark, sql):
    assert sql_door.classify(sql).regions is None


def test_provenance_of_row_functions(spark):
    assert sql_door.classify("SELECT upper(substr(path, 1, 2)) FROM doc AS d WHERE d.path = 'a' AND length(path) > 0 ORDER BY path").regions == {"a"}


def test_escapes_and_quotes():
    assert frontmatter.decode('"a\\u00e9"') == ("a\\u00e9", True)
    assert frontmatter.decode('"a\\n\\"b"') == ('a\n"b', True)
    assert frontmatter.decode('"a\\"') == ('"a\\"', False) and frontmatter.decode("'it''s'") == ("it's", True)


def test_qualified_names_are_whole_endings(spark):
    ws = views.Workspace(project.parse_pages(spark.createDataFrame([("x/y/readme.md", "[[y/readme]] [[x/y/readme]] [[z/readme]] [[readme]]\n"), ("xy/readme.md", "[[y/readme]]\n"), ("z/readme.md", "[[up:readme]] [[#here]]\n")], "path string, raw string")))
    got = {(r.src_path, r.target_raw): r.dest_path for r in ws.link.collect()}
    assert got["x/y/readme.md", "y/readme"] == got["x/y/readme.md", "x/y/readme"] == got["xy/readme.md", "y/readme"] == "x/y/readme.md"
    assert got["x/y/readme.md", "z/readme"] == "z/readme.md" and got["x/y/readme.md", "readme"] == "x/y/readme.md"
    assert got["z/readme.md", "up:readme"] is None and got["z/readme.md", ""] == "z/readme.md"


@pytest.mark.parametrize(
    ("sql", "regions"),
    [
        ("SELECT * FROM doc WHERE path = 'a.md'", {"a.md"}),
        ("SELECT * FROM section s WHERE s.path LIKE 'notes/%' AND level = 1;", {"notes/*"}),
        ("SELECT key FROM frontmatter WHERE path IN ('a', 'b') ORDER BY key", {"a", "b"}),
        ("SELECT * FROM doc WHERE path = 'a' OR path = 'b'", None),
        ("SELECT * FROM doc", None),
        ("SELECT * FROM backlink WHERE path = 'a'", None),
        ("SELECT count(*) FROM doc WHERE path = 'a'", None),
        ("SELECT * FROM doc WHERE path = 'a' LIMIT 1", None),
    ],
)
def test_provenance(sql, regions):
    assert sql_door.classify(sql).regions == (None if regions is None else frozenset(regions))


def test_files(spark, tmp_path):
    for name, text in (("a.md", "x"), ("sub/b.md", "y"), ("d.txt", "t"), ("skip/e.md", "e")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = workspace.read_files(spark, str(tmp_path))
    inside, outside = workspace.domain(files, ["skip/", "!skip/keep.md"])
    assert {r.path for r in inside.collect()} == {"a.md", "sub/b.md"}
    assert {r.path: r.reason for r in outside.collect()} == {"d.txt": "not-markdown", "skip/e.md": "ignored"}
    hidden = spark.createDataFrame([("a/.hid/c.md",)], "path string")
    assert workspace.domain(hidden, [])[1].first().reason == "dot-segment"
    assert workspace.unmoved(files, files).isEmpty()


def test_side_relations(spark):
    raw = spark.createDataFrame([("x.base", "views: [{name: V, type: t}]\n"), ("y.base", "a: 1\na: 2\n"), ("c.canvas", '{"file":"q.md"}')], "path string, raw string")
    got = {r.path: r for r in workspace.bases(raw.where("path LIKE '%.base'")).collect()}
    assert got["x.base"].views[0].name == "V" and got["y.base"].error and not got["y.base"].views
    assert workspace.canvases(raw.where("path = 'c.canvas'")).first().text == "q.md"
    assert workspace.parse_address("root:a/b.md#H>I") == ("root", "a/b.md", "H>I") and workspace.from_uri(workspace.to_uri("v 1", "a/é.md")) == ("v 1", "a/é.md")


def test_colours_of_real_pins(spark):
    target = "---\nk: 1\n---\n# B\ntext ^x\n\n# C\n# C\n"
    span = lock.span_fingerprint(b"# B\ntext\n\n")
    made = [
        lock.Pin("b", "path", ("B",), span, "0"), lock.Pin("b", "path", ("B",), lock.span_fingerprint(b"old"), "0"), lock.Pin("b", "path", ("C",), span, "0"), lock.Pin("b", "path", ("D",), span, "0"),
        lock.Pin("b", "properties", ("k",), lock.property_fingerprint({"k": "1"}, ["k"]), "0"), lock.Pin("b", "path", (), "fp1.span2.b3.x", "0"), lock.Pin("b", "path", (), "fp9.a.b.00", "0"), lock.Pin("gone", "path", (), span, "0"), lock.Pin("out.txt", "path", (), span, "0"), lock.Pin("other:b", "path", (), span, "0"),
        lock.Pin("b", "path", ("^x",), lock.span_fingerprint(b"text"), "0"),
    ]
    found = pages(spark, a=f"{lock.render(made)}\n", b=target, c=f"```{lock.LANGUAGE}\nversion: 1\n```\n")
    ws = views.Workspace(project.parse_pages(found))
    listing = spark.createDataFrame([("out.txt", "not-markdown")], "path string, reason string")
    got = {r.seq: (r.tone, r.reason) for r in pins.coloured(ws.lock, ws.lock_fault, found, listing).collect()}
    assert got == {
        0: ("green", "green"), 1: ("red", "drifted"), 2: ("grey", "ambiguous"), 3: ("red", "selector-unresolved"), 4: ("green", "green"), 5: ("grey", "malformed-fingerprint"), 6: ("grey", "unverifiable-fingerprint"),
        7: ("red", "file-not-found"), 8: ("grey", "outside-domain"), 9: ("grey", "unmounted"), 10: ("green", "green"), None: ("grey", "lock-refused"),
    }


def test_addresses(spark):
    corpora = spark.createDataFrame([(None, "a.md"), (None, "d/b.md"), (None, "e/b.md"), (None, "x"), ("lib", "a.md"), ("lib", "q/z.md")], "root string, path string")
    aliases = spark.createDataFrame([(None, "a.md", "first"), ("lib", "a.md", "far")], "root string, path string, alias string")
    asked = spark.createDataFrame([("e/s.md", r) for r in ("a.md", "a", "b", "D/b", "first", "far", "lib:far", "lib:z#H", "no:z", "nope", "#H", "lib:a:b", "x")], "src_path string, ref string")
    got = {r.ref: (r.outcome, r.dest_path) for r in resolve.resolve_refs(asked, corpora, aliases).collect()}
    assert got == {
        "a.md": ("ambient", "a.md"), "a": ("ambient", "a.md"), "b": ("ambient", "e/b.md"), "D/b": ("ambient", "d/b.md"), "first": ("ambient", "a.md"), "far": ("not-found", None), "lib:far": ("rooted", "a.md"),
        "lib:z#H": ("rooted", "q/z.md"), "no:z": ("unmounted", None), "nope": ("not-found", None), "#H": ("malformed", None), "lib:a:b": ("malformed", None), "x": ("ambient", "x"),
    }


def test_minted_addresses(spark):
    ws = views.Workspace(project.parse_pages(pages(spark, a="---\nk: 1\n---\n# A\n## B\n## B\nx ^i\n")))
    asked = spark.createDataFrame([("a.md", *x) for x in (("hpath", '[{"h":"A"}]'), ("hpath", '[{"h":"A"},{"h":"B"}]'), ("hpath", '[{"h":"A"},{"h":"B","n":2}]'), ("anchor", "i"), ("fm_key", "k"), ("fm_key", "no"))], "path string, kind string, address string")
    got = {(r.kind, r.address): (r.n, r.span_start) for r in pins.minted(asked, ws.section, ws.anchor, ws.frontmatter).collect()}
    assert [n for n, _ in got.values()].count(1) == 4 and got["hpath", '[{"h":"A"},{"h":"B"}]'] == (2, None) and got["fm_key", "no"] == (0, None)


def test_refused_edits(spark):
    found = pages(spark, a="# A\nx x y\n")
    ws = views.Workspace(project.parse_pages(found))
    hpath, rev = '[{"h":"A"}]', ws.section.first().node_rev
    rows = [("a.md", hpath, rev, "y", 0, 2), ("a.md", hpath, "0", None, 1, 3), ("a.md", hpath, rev, "x", 5, 6), ("a.md", "[]", None, None, 7, 8), ("b.md", None, None, "y", 0, 1)]
    edits = spark.createDataFrame(rows, "path string, hpath string, rev string, old string, span_start long, span_end long")
    assert sorted(r.reason for r in relocate.refused(edits, ws.section, found).collect()) == ["ambiguous", "moved", "no-page", "no-section", "overlap"]


def test_rules_over_roots(spark):
    paths = spark.createDataFrame([("a/b/c.md",), ("a/x.md",), ("q.md",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {r.path: r.root for r in rules.nearest_root(paths, roots).collect()} == {"a/b/c.md": "a/b", "a/x.md": "a", "q.md": None}
    broken = rules.run_query_rule(spark, rules.QueryRule("r", "SELECT nope FROM nothing_there"))
    assert broken.first().path is None and rules.gate(broken).first().warnings == 1
    paths.createOrReplaceTempView("doc_for_rules")
    missed = rules.run_query_rule(spark, rules.QueryRule("r", "SELECT path FROM doc_for_rules WHERE path LIKE 'a/%'", root="a/b", control="q.md"))
    assert sorted(str(r.path) for r in missed.collect()) == ["None", "a/b/c.md"]
    assert rules.glob_pattern("a/**/*.md") == "^a/(?:.*/)?[^/]*\\.md$" and rules.pure(["path", "clock_now"]) == ["clock_now"]


def test_a_check_is_a_column_or_a_function(spark):
    changes = spark.createDataFrame([("a.md", "1", "2"), ("b.md", None, "2"), ("c.md", "2", None)], "path string, value_before string, value_after string")
    as_column = rules.check_changes(changes, F.when(F.col("value_after") == "2", F.concat(F.lit("was "), F.coalesce("value_before", F.lit("none")))), "two")
    as_function = rules.check_changes(changes, lambda c: f"was {c['value_before'] or 'none'}" if c["value_after"] == "2" else None, "two")
    assert as_column.columns == as_function.columns
    assert sorted(map(tuple, as_column.collect())) == sorted(map(tuple, as_function.collect())) == [("two", "block", "a.md", "was 1"), ("two", "block", "b.md", "was none")]

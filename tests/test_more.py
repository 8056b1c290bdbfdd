"""Policy files, documents with a stat bracket, merging, sessions and other small parts."""

import json
import os

from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.operators import ignore, index, reconcile, stats
from siftwood.plans import find as FI
from siftwood.plans import grep as G
from siftwood.sources import catalog
from siftwood.streaming import feeds


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_ignore_files_are_read_and_work_trees_reset_them(spark, tmp_path):
    top = str(tmp_path)
    put(f"{top}/.gitignore", "*.log\n# note\n")
    put(f"{top}/repo/.git/info/exclude", "local.txt\n")
    put(f"{top}/repo/.gitignore", "!keep.tmp\n*.tmp\n")
    put(f"{top}/repo/a.log", "x")
    put(f"{top}/repo/b.tmp", "x")
    put(f"{top}/repo/local.txt", "x")
    put(f"{top}/c.log", "x")
    rules = ignore.read_rules(catalog.crawl(spark, top))
    assert {(r.dir, r.band, r.negate) for r in rules.collect()} == {(top, 2, False), (f"{top}/repo", 1, False), (f"{top}/repo", 2, True), (f"{top}/repo", 2, False)}
    entries = catalog.crawl(spark, top).filter("depth > 0")
    plain = {r.path.removeprefix(top): r.decision for r in ignore.decide(entries, rules).collect()}
    assert plain["/c.log"] == plain["/repo/a.log"] == plain["/repo/b.tmp"] == plain["/repo/local.txt"] == "skip"
    trees = spark.createDataFrame([(f"{top}/repo",)], "dir string")
    inside = {r.path.removeprefix(top): r.decision for r in ignore.decide(entries, rules, work_trees=trees).collect()}
    assert inside["/repo/a.log"] == "index" and inside["/c.log"] == inside["/repo/b.tmp"] == "skip"


def test_crawl_finds_everything_once(spark, tmp_path):
    for k in range(5):
        put(f"{tmp_path}/d{k}/e{k % 2}/f{k}.txt", "x" * k)
    os.symlink("d0", f"{tmp_path}/link")
    rows = catalog.crawl(spark, str(tmp_path)).select("path", "kind").collect()
    want = {str(tmp_path)} | {os.path.join(d, n) for d, ds, fs in os.walk(tmp_path) for n in ds + fs}
    assert sorted(r.path for r in rows) == sorted(want)


def test_documents_that_changed_while_read_are_faults(spark, tmp_path):
    put(f"{tmp_path}/a.txt", "one")
    put(f"{tmp_path}/b.txt", "two")
    before = spark.createDataFrame(catalog.crawl(spark, str(tmp_path)).collect(), catalog.ENTRY)
    contents = catalog.read_contents(spark, str(tmp_path))
    put(f"{tmp_path}/b.txt", "longer")
    got = {os.path.basename(r.path): (r.state, r.content and bytes(r.content)) for r in catalog.read_documents(before, contents, catalog.crawl(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("Hashed", b"one"), "b.txt": ("Fault", None)}


def test_base64_and_utf8_fields(spark):
    rows = spark.createDataFrame([(b"plain",), (b"a\xffb",)], "b binary")
    got = [tuple(r) for r in rows.select(*T.bytes_fields(F.col("b"), "name"), T.bytes_item(F.col("b"))).collect()]
    assert got == [("plain", None, '"plain"'), ("a�b", "Yf9i", '{"base64":"Yf9i"}')]


def test_merge_drops_dead_and_counts_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "doc_id long, text string")
    parts = [index.build(docs.filter("doc_id < 3")), index.build(docs.filter("doc_id > 1"))]
    merged = index.merge(parts, docs.filter("doc_id != 3"))
    assert {(r.term, r.df) for r in index.terms(merged.postings).collect()} == {("alpha", 1), ("beta", 2)}
    assert sorted(r.doc_id for r in merged.coverage.collect()) == [1, 2]


def test_index_is_written_and_read_again(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 3} common") for k in range(50)], "doc_id long, text string")
    index.build(docs).write(str(tmp_path), 4)
    again = index.Index.read(spark, str(tmp_path))
    assert index.documents_with(again.postings, "common").count() == 50 and again.grams.filter("key = 'wor'").count() == 50
    assert not [n for n in os.listdir(tmp_path) if n.startswith("raw")]
    plan = index.documents_with(again.postings, "common")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,common)" in plan


def test_sessions_cross_stretches(spark):
    events = [("r", 59_900 + 150 * k, "s") for k in range(6)] + [("r", 200_000, "s"), ("q", 5, "s")]
    got = {(r.root, r.ms): r.session for r in feeds.sessions(spark.createDataFrame(events, "root string, ms long, scope string")).collect()}
    assert {got["r", ms] for _, ms, _ in events[:6]} == {59_900} and got["r", 200_000] == 200_000 and got["q", 5] == 5


def test_percentiles_refine_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(stats, "SORTED", 8)
    monkeypatch.setattr(stats, "PARTS", 4)
    values = sorted((k * 7919) % 1024 + 1024 for k in range(900)) + [-5, 0, 3]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.q: r.value for r in stats.percentiles(rows, "v").collect()}
    ordered = sorted(values)
    assert got == {q: ordered[int((len(ordered) - 1) * q + 0.5)] for q in (0.5, 0.9, 0.99, 1.0)}


def test_versions_and_logs(spark, tmp_path):
    base = spark.createDataFrame([(1, 1.0)], "id long, value double")
    log = lambda seq, v: spark.createDataFrame([(1, seq, "put", v)], "id long, seq long, kind string, value double")
    assert reconcile.published(spark, str(tmp_path)) is None
    for k in range(3):
        path = reconcile.compact(base, log(k, float(k)), str(tmp_path))
        assert reconcile.published(spark, str(tmp_path)).number == k and path.endswith(reconcile.published(spark, str(tmp_path)).version)
    reconcile.append_log(log(7, 7.0), f"{tmp_path}/log")
    reconcile.append_log(log(8, 8.0), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert catalog.log_query(spark, f"{tmp_path}/queries", {"args": ["x"], "rows": 3})
    assert json.loads(spark.read.text(f"{tmp_path}/queries").first().value) == {"args": ["x"], "rows": 3}
    events = catalog.batch_events("7", base).orderBy("seq").collect()
    assert [e.event for e in events] == ["begin", "row", "end"] and json.loads(events[1].row) == {"id": 1, "value": 1.0}


def test_quit_alone_prints_nothing(spark):
    rows = spark.createDataFrame([("/r", "r", 0, "dir"), ("/r/a-b", "a-b", 1, "file"), ("/r/a", "a", 1, "dir"), ("/r/a/b", "b", 2, "file")], "path string, name string, depth int, kind string").withColumn("root", F.lit("/r"))
    ask = lambda *a: [r.path for r in FI.paths(rows, list(a), FI.Context(0)).collect()]
    assert ask("-name", "b", "-quit") == []
    assert sorted(ask("-name", "a*", "-print", "-o", "-name", "b", "-quit")) == ["/r/a"]
    # with -depth a directory comes behind what it holds
    assert ask("-depth", "-name", "a", "-quit", "-o", "-name", "b", "-print") == ["/r/a/b"]


def test_headings_and_types(spark):
    found = spark.createDataFrame([("p", 3, "line")], "path string, line_no int, line string")
    show = lambda *a: sorted(r.record for r in G.presented(found, G.parse([*a, "x"])).collect())
    assert show("-H", "-n") == ["p:3:line"] and show("-H", "-0") == ["p\x00line"] and show("-H", "--heading", "-n") == ["3:line", "p"] and show("-I") == ["line"]
    assert len(G.TYPES) >= 200
    names = spark.createDataFrame([("a.zig",), ("b.thrift",), ("LICENSE",)], "n string")
    assert [r.n for r in names.filter(G.type_selected(F.col("n"), [(True, "thrift"), (True, "license")])).collect()] == ["b.thrift", "LICENSE"]

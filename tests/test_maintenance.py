import time

import pytest
from pyspark.sql import functions as F

from siftwood.operators import ignore, index, reconcile, stats
from siftwood.sources import catalog
from siftwood.sources.workspace import Workspace
from siftwood.streaming import feeds

STAT = "parent string, name string, dev long, ino long, kind string, size long, mtime_s long, mtime_ns int, ctime_s long, ctime_ns int, mode int, uid long, gid long, nlink long, target string, hash string, state string, doc_id long"


def row(parent, name, ino, size=1, kind="file", target=None, hash="h", state="Hashed", doc=1):
    return (parent, name, 1, ino, kind, size, 5, 0, 5, 0, 420, 0, 0, 1, target, hash, state, doc)


def test_reconcile(spark):
    old = spark.createDataFrame([row("/a", "x", 1), row("/a", "y", 2), row("/b", "z", 3), row("/a", "l", 4, kind="symlink", target="x")], STAT)
    new = spark.createDataFrame([row("/a", "x", 1, size=9), row("/a", "n", 5), row("/a", "l", 4, kind="symlink", target="y")], STAT)
    got = lambda df: sorted((r.kind, r.parent, r.name) for r in df.collect())
    assert got(reconcile.diff(old, new)) == [("delete", "/a", "y"), ("delete", "/b", "z"), ("insert", "/a", "n"), ("update", "/a", "l"), ("update", "/a", "x")]
    covered = spark.createDataFrame([("/a",)], "path string")
    assert ("delete", "/b", "z") not in got(reconcile.diff(old, new, covered))
    assert got(reconcile.diff(old, new, protected=covered)) == [("delete", "/b", "z")]
    records = [(r.kind, r.key, r.payload if r.kind == "LinkPut" else None) for r in reconcile.change_records(old, new).collect()]
    assert records == sorted(records, key=lambda r: r[:2]) and ("LinkPut", "/a/l", "y") in records and ("NameDelete", "/b/z", None) in records


def test_aliases_and_carry_over(spark):
    seen = spark.createDataFrame([row("/a", "x", 1), row("/b", "x2", 1), row("/a", "p", 2), row("/b", "q", 2, size=7)], STAT)
    got = {r.ino: (r.name, r.state, r.hash, r.aliases) for r in reconcile.canonical(seen).collect()}
    assert got == {1: ("x", "Hashed", "h", 2), 2: ("p", "Fault", None, 2)}
    old = spark.createDataFrame([row("/a", "x", 1, doc=11), row("/a", "f", 3, state="Fault")], STAT)
    now = spark.createDataFrame([row("/a", "x", 1), row("/a", "f", 3), row("/a", "w", 4)], STAT)
    assert {r.name: r.carried_doc for r in reconcile.carry_over(now, old).collect()} == {"x": 11, "f": None, "w": None}
    with pytest.raises(reconcile.Stale):
        reconcile.check_generation({"generation": 1}, {"generation": 2})


def test_log_and_ids(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, value string")
    log = spark.createDataFrame([(1, 1, "put", "A"), (2, 2, "put", "B"), (2, 3, "delete", None), (4, 4, "put", "D")], "id long, seq long, kind string, value string")
    expected = [(1, "A"), (3, "c"), (4, "D")]
    assert sorted(map(tuple, reconcile.overlay(base, log).collect())) == expected
    where = reconcile.compact(base, log, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(where).collect())) == expected
    assert reconcile.needs_compaction(1, 1, 2, 0) and not reconcile.needs_compaction(1, 1, 0, 0)
    hashes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "hash string")
    live, dormant = (spark.createDataFrame(x, "hash string, doc_id long") for x in ([("a", 5)], [("b", 3)]))
    got = {r.hash: r.doc_id for r in reconcile.assign_documents(hashes, live, dormant, 10).collect()}
    assert got["a"] == 5 and got["b"] == 3 and sorted([got["c"], got["d"]]) == [10, 11]
    assert {r.hash: r.doc_id for r in reconcile.assign_documents(hashes, live, dormant, 10, covered=False).collect()}["b"] >= 10


def test_renames(spark):
    events = spark.createDataFrame([(1, "moved_from", "/a", "x"), (1, "moved_to", "/b", "y"), (2, "moved_from", "/a", "z")], "cookie long, mask string, dir string, name string")
    assert [tuple(r)[1:] for r in reconcile.rename_pairs(events).collect()] == [("/a/x", "/b/y")]


def test_bursts(spark):
    assert feeds.fold_bursts([(0, "a"), (150, "b"), (340, "a"), (600, "c")]) == [(0, 340, ["a", "b"], 3, False), (600, 600, ["c"], 1, False)]
    steady = [(k * 100, "s") for k in range(15)]
    assert [b[3] for b in feeds.fold_bursts(steady)] == [10, 5]
    rows = spark.createDataFrame([("r", k * 100, "s") for k in range(15)] + [("q", 5, "t")], "root string, ms long, scope string")
    assert sorted((r.root, r.n, r.due_ms) for r in feeds.bursts(rows).collect()) == [("q", 1, 205), ("r", 5, 1600), ("r", 10, 1000)]


def test_stream_bursts(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.createDataFrame([("r", ms, "s") for ms in (0, 50, 400, 420, 900)], "root string, ms long, scope string").coalesce(1).write.parquet(source)
    stream = feeds.stream_bursts(feeds.change_feed(spark, source, "root string, ms long, scope string"))
    run = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            if spark.sql("select count(*) from bursts").first()[0] >= 3:
                break
            time.sleep(0.3)
    finally:
        run.stop()
    assert sorted((r.first_ms, r.n) for r in spark.sql("select * from bursts").collect()) == [(0, 2), (400, 2), (900, 1)]


def test_follow_and_replay_streams(spark, tmp_path):
    docs, folder = str(tmp_path / "docs"), str(tmp_path / "index")
    spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string").write.parquet(docs)
    for more in ((3, "beta gamma"), (4, "delta")):
        feeds.follow_index(feeds.change_feed(spark, docs, "doc_id long, text string"), folder, str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([more], "doc_id long, text string").write.mode("append").parquet(docs)
    built = index.Index.read(spark, folder)
    assert sorted(r.doc_id for r in index.documents_with(built.postings, "beta").collect()) == [1, 2, 3]
    assert built.coverage.count() == 3
    assert index.purge(built, spark.range(1, 2).toDF("doc_id")).coverage.count() == 1
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id long, seq long, value string").write.parquet(log)
    feeds.replay_log(feeds.change_feed(spark, log, "id long, seq long, value string"), state, str(tmp_path / "ck2")).awaitTermination()
    spark.createDataFrame([(1, 3, "c"), (2, 4, "d")], "id long, seq long, value string").write.mode("append").parquet(log)
    feeds.replay_log(feeds.change_feed(spark, log, "id long, seq long, value string"), state, str(tmp_path / "ck2")).awaitTermination()
    version = reconcile.published(spark, str(state)).version
    assert sorted((r.id, r.value) for r in spark.read.parquet(f"{state}/{version}").collect()) == [(1, "c"), (2, "d")]


def entries(spark, paths):
    rows = [(p.rstrip("/"), p.rstrip("/").rsplit("/", 1)[1], "/r", "dir" if p.endswith("/") else "file", 10, p.count("/")) for p in paths]
    return spark.createDataFrame(rows, "path string, name string, root string, kind string, size long, depth int")


def test_ignore(spark):
    rules = ignore.rules(spark, [("", "global", ["*.log", "out/"]), ("/r", ".gitignore", ["*.bak", "/only", "gen/"]), ("/r/s", ".gitignore", ["!keep.bak"]), ("/r", ".siftignore", ["!gen/want.c", "secret*"]), ("/r/s", ".siftignore", ["!secret.s"])], "/r")
    paths = ["/r/a.log", "/r/b.bak", "/r/s/", "/r/s/keep.bak", "/r/s/other.bak", "/r/only", "/r/s/only", "/r/gen/", "/r/gen/want.c", "/r/gen/junk.c", "/r/secret.x", "/r/s/secret.s", "/r/s/out/", "/r/s/out/z"]
    got = {r.path: r.decision for r in ignore.decide(entries(spark, paths), rules).collect()}
    assert got == {
        "/r/a.log": "skip", "/r/b.bak": "skip", "/r/s": "descend", "/r/s/keep.bak": "index", "/r/s/other.bak": "skip", "/r/only": "skip", "/r/s/only": "index", "/r/gen": "traverse", "/r/gen/want.c": "index",
        "/r/gen/junk.c": "skip", "/r/secret.x": "skip", "/r/s/secret.s": "index", "/r/s/out": "traverse", "/r/s/out/z": "skip",
    }


def test_percentiles_and_buckets(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 100, 1000)], "v long")
    assert {r.bucket: (r.n, r.total) for r in stats.histogram(rows, "v").collect()} == {0: (1, 0), 1: (1, 1), 2: (2, 5), 3: (1, 4), 7: (1, 100), 10: (1, 1000)}
    assert {r.q: r.value for r in stats.percentiles(rows, "v").collect()} == {0.5: 3, 0.9: 100, 0.99: 1000, 1.0: 1000}
    assert stats.percentiles(rows.limit(0), "v").count() == 0
    names = spark.createDataFrame([("a.RS",), (".rs",), ("x",), ("b.tar.gz",)], "name string")
    assert [r.e for r in names.select(stats.extension(F.col("name")).alias("e")).collect()] == ["rs", "", "", "gz"]


def test_requests_and_identities(spark):
    lines = spark.createDataFrame([('{"id":"1","op":"find","args":["a"]}',), ("{nope",), ('{"id":"2","op":"zap"}',)], "value string")
    assert [r.error for r in catalog.batch_requests(lines).collect()] == [None, "malformed", "unknown-op"]
    assert [tuple(r) for r in catalog.identities(spark, ["root:x:0:0", "toor:x:0:0", "bad", "u:x:7:7"]).collect()] == [(0, "root"), (7, "u")]


def test_workspace_and_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("hello")
    (tmp_path / "d" / "g.bin").write_bytes(b"a\x00b")
    rows = catalog.crawl(spark, str(tmp_path / "d"))
    contents = {r.path.rsplit("/", 1)[1]: r.binary for r in catalog.read_contents(spark, str(tmp_path / "d")).collect()}
    assert contents == {"f.txt": False, "g.bin": True}
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    space = Workspace.create(spark, rows, docs, str(tmp_path / "w"))
    assert space.entries.filter("kind = 'dir'").count() == 1 and index.documents_with(space.index.postings, "hello").count() == 1
    loop = spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("c", "d", "c"), ("d", "c", "d")], "node string, parent string, name string")
    assert sorted(r.path for r in catalog.resolve_paths(loop).collect()) == ["/a", "/a/b"]

"""The catalog: a file tree as tables, from documents, from a table tree or from disk.

``entries`` is the unified view that the query languages use: one row for each path,
with depth, kind and inode metadata. Paths are materialised when a catalog is built, so
scopes and depths are plain filters. Times are seconds and nanoseconds in two columns.
"""

from __future__ import annotations

import os
import stat as st
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = (
    "path string, name string, parent string, root string, depth int, kind string, size long, mtime_s long, mtime_ns int, ctime_s long, ctime_ns int, "
    "atime_s long, atime_ns int, dev long, ino long, mode int, uid long, gid long, nlink long, entries long, target string, doc_id long, state string"
)
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
ROOT = "/corpus"


def _complete(df: DataFrame) -> DataFrame:
    """All columns of ENTRY in order, missing ones null."""
    have = set(df.columns)
    parts = [c.rsplit(" ", 1) for c in ENTRY.split(", ")]
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in parts])


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular files of the corpus tree: a document each, metadata from its event."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("size"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"), "ts", "user_id")
    files = docs.join(events, "doc_id")
    parent = F.concat_ws("/", F.lit(ROOT), "source", "lang")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".rs").otherwise(".txt"))
    # the events of the documents lie within days; their files' ages spread over weeks
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.col("doc_id") * 7, F.lit(25)) * 86_400_000_000
    mtime, ns = F.floor(micros / 1_000_000).cast("long"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int")
    rows = files.select(
        F.concat_ws("/", parent, name).alias("path"), name.alias("name"), parent.alias("parent"), F.lit(ROOT).alias("root"), F.lit(3).alias("depth"), F.lit("file").alias("kind"), "size",
        mtime.alias("mtime_s"), ns.alias("mtime_ns"), mtime.alias("ctime_s"), ns.alias("ctime_ns"), (mtime + 3600 * (1 + F.col("doc_id") % 60)).alias("atime_s"), ns.alias("atime_ns"),
        F.lit(1).alias("dev"), (F.col("doc_id") + 1000).alias("ino"), F.pmod(F.col("doc_id") * 73, F.lit(4096)).alias("mode"), F.col("user_id").alias("uid"), F.pmod("user_id", F.lit(7)).alias("gid"),
        F.lit(1).alias("nlink"), "doc_id", F.lit("Hashed").alias("state"),
    )
    return _complete(rows)


def corpus_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the corpus and the directories above them (depth 0 to 2)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang")
    leaves = docs.groupBy("source", "lang").agg(F.count("*").alias("entries"))
    level2 = leaves.select(F.concat_ws("/", F.lit(ROOT), "source", "lang").alias("path"), F.col("lang").alias("name"), F.concat_ws("/", F.lit(ROOT), "source").alias("parent"), F.lit(2).alias("depth"), "entries")
    level1 = leaves.groupBy("source").agg(F.count("*").alias("entries")).select(F.concat_ws("/", F.lit(ROOT), "source").alias("path"), F.col("source").alias("name"), F.lit(ROOT).alias("parent"), F.lit(1).alias("depth"), "entries")
    level0 = leaves.agg((F.count_distinct("source") + 1).alias("entries")).select(F.lit(ROOT).alias("path"), F.lit("corpus").alias("name"), F.lit("/").alias("parent"), F.lit(0).alias("depth"), "entries")
    dirs = level0.union(level1).union(level2).withColumns({"root": F.lit(ROOT), "kind": F.lit("dir"), "size": F.lit(4096), "mode": F.lit(0o755), "dev": F.lit(1), "nlink": F.lit(2), "uid": F.lit(0), "gid": F.lit(0), "ino": F.pmod(F.xxhash64("path"), F.lit(1 << 40)) + F.lit(1 << 41), "mtime_s": F.lit(1_700_000_000), "mtime_ns": F.lit(0), "ctime_s": F.lit(1_700_000_000), "ctime_ns": F.lit(0), "atime_s": F.lit(1_700_000_000), "atime_ns": F.lit(0)})
    return corpus_files(spark, sf_dir).unionByName(_complete(dirs)).unionByName(_special_entries(spark, sf_dir))


#: What the special entry of a nation links to: a directory, nothing, a directory, itself, another link.
TARGETS = {0: f"{ROOT}/src1", 5: f"{ROOT}/missing", 10: f"{ROOT}/src3/en", 15: "x15", 20: "x0"}


def _special_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of entries that are no documents, one for each nation: links, empty
    files, empty directories, names of one inode and devices; the last five lie on
    another device, and their owners are unknown."""
    n = F.col("n_nationkey").cast("long")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("n"))
    which, n = F.col("n") % 5, F.col("n")
    kind = F.when(which == 0, "symlink").when(which == 2, "dir").when(which == 4, F.when(n < 10, "fifo").when(n < 15, "socket").when(n < 20, "block").otherwise("character")).otherwise("file")
    target = F.lit(None).cast("string")
    for k, text in TARGETS.items():
        target = F.when(n == k, text).otherwise(target)
    name = F.concat(F.lit("x"), n.cast("string"))
    inner = n.isin(21, 23)
    parent = F.when(inner, f"{ROOT}/extra/x22").otherwise(f"{ROOT}/extra")
    stamps = {f"{x}time_{u}": F.lit(1_700_000_000 if u == "s" else 0) for x in "mca" for u in ("s", "ns")}
    rows = nations.select(
        F.concat_ws("/", parent, name).alias("path"), name.alias("name"), parent.alias("parent"), F.when(inner, 3).otherwise(2).alias("depth"), kind.alias("kind"), F.when(which == 3, 700).when(which == 2, 4096).when(which == 0, F.octet_length(target)).otherwise(0).alias("size"),
        F.when(n == 22, 2).when(which == 2, 0).alias("entries"), F.pmod(n * 73, F.lit(4096)).alias("mode"), F.when(n >= 20, 2).otherwise(1).alias("dev"), F.when(which == 3, 900 + F.floor(n / 20)).otherwise(500 + n).alias("ino"), F.when(which == 3, F.when(n >= 20, 1).otherwise(4)).otherwise(1).alias("nlink"),
        (n + 1_000_000).alias("uid"), F.pmod(n, F.lit(7)).alias("gid"), target.alias("target"), F.lit("Unindexed").alias("state"),
    )
    top = nations.filter("n not in (21, 23)").agg(F.count("*").alias("entries")).select(F.lit(f"{ROOT}/extra").alias("path"), F.lit("extra").alias("name"), F.lit(ROOT).alias("parent"), F.lit(1).alias("depth"), F.lit("dir").alias("kind"), F.lit(4096).alias("size"), "entries", F.lit(0o755).alias("mode"), F.lit(1).alias("dev"), F.lit(499).alias("ino"), F.lit(2).alias("nlink"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("state"))
    return _complete(rows.unionByName(top).withColumns({"root": F.lit(ROOT), **stamps}))


def ids_of(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """path, dev, ino, doc_id of the asked paths (path); unknown ones have nulls."""
    return paths.select("path").join(entries.select("path", "dev", "ino", "doc_id"), "path", "left")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of the catalog's documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def table_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region - nation - customer - order as (node, parent, name): parent pointers, as a
    catalog stores names. Nodes are unique strings; roots have no parent."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region = read("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = read("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_name"))
    customer = read("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_name"))
    orders = read("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")))
    return region.union(nation).union(customer).union(orders)


def resolve_paths(edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """node, path, depth from parent pointers (node, parent, name), level by level. A
    cycle or a missing ancestor leaves its nodes without a path, so they drop out."""
    known = edges.filter("parent is null").select("node", F.concat(F.lit("/"), "name").alias("path"), F.lit(0).alias("depth"))
    levels, frontier = [known], known
    children = edges.filter("parent is not null")
    for depth in range(1, most_depth):
        frontier = children.join(frontier.select(F.col("node").alias("parent"), F.col("path").alias("above")), "parent").select("node", F.concat("above", F.lit("/"), "name").alias("path"), F.lit(depth).alias("depth")).persist()
        # each level is computed once: for the test, the next level and the result
        if frontier.isEmpty():
            frontier.unpersist()
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def file_kind(mode: int) -> str:
    for test, name in ((st.S_ISDIR, "dir"), (st.S_ISREG, "file"), (st.S_ISLNK, "symlink"), (st.S_ISFIFO, "fifo"), (st.S_ISSOCK, "socket"), (st.S_ISBLK, "block"), (st.S_ISCHR, "character")):
        if test(mode):
            return name
    return "file"


def _entry(path: str, root: str, depth: int) -> tuple | None:
    try:
        s = os.lstat(path)
    except OSError:
        return None
    kind, entries = file_kind(s.st_mode), None
    if kind == "dir":
        try:
            entries = len(os.listdir(path))
        except OSError:
            entries = None
    target = os.readlink(path) if kind == "symlink" else None
    times = [x for ns in (s.st_mtime_ns, s.st_ctime_ns, s.st_atime_ns) for x in divmod(ns, 10**9)]
    return (path, os.path.basename(path.rstrip("/")) or "/", os.path.dirname(path), root, depth, kind, s.st_size, *times, s.st_dev, s.st_ino, st.S_IMODE(s.st_mode), s.st_uid, s.st_gid, s.st_nlink, entries, target, None, "Unindexed")


class _TreeReader(DataSourceReader):
    """Walks a directory tree in WALKERS partitions or more: the driver opens directories,
    breadth-first and at most OPENED of them, until there are enough subtrees."""

    WALKERS, OPENED = 256, 1024

    def __init__(self, options) -> None:
        self.root = options["path"].rstrip("/") or "/"

    def partitions(self) -> list[InputPartition]:
        opened, waiting, at = [], [(self.root, 0)], 0
        while at < len(waiting) and len(waiting) - at < self.WALKERS and len(opened) < self.OPENED:
            path, depth = waiting[at]
            at += 1
            opened.append((path, depth))
            if os.path.isdir(path) and not os.path.islink(path):
                try:
                    waiting += [(os.path.join(path, n), depth + 1) for n in sorted(os.listdir(path))]
                except OSError:
                    continue
        return [InputPartition((False, opened)), *(InputPartition((True, [x])) for x in waiting[at:])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        deep, stack = partition.value
        stack = list(stack)
        while stack:
            path, depth = stack.pop()
            row = _entry(path, self.root, depth)
            if row is None:
                continue
            yield row
            if deep and row[5] == "dir":
                try:
                    stack += [(os.path.join(path, n), depth + 1) for n in sorted(os.listdir(path), reverse=True)]
                except OSError:
                    continue


class TreeSource(DataSource):
    """``spark.read.format("tree").load(path)``: a live walk as ENTRY rows. Unreadable
    directories keep their row and have null ``entries``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def crawl(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").load(path)


def read_contents(spark: SparkSession, path: str, cap: int = 8 << 20) -> DataFrame:
    """path, content, binary of the files under a folder, up to ``cap`` bytes each."""
    from siftwood.functions.text import is_binary

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= cap)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", is_binary(F.col("content")).alias("binary"))


def read_documents(entries: DataFrame, contents: DataFrame, after: DataFrame) -> DataFrame:
    """path, dev, ino, content, state of regular files: ``entries`` were observed before
    their contents (path, content, binary) were read, ``after`` behind that. A file whose
    size or times changed in between, or that is gone, is a Fault without content."""
    stat = ["dev", "ino", "size", "mtime_s", "mtime_ns", "ctime_s", "ctime_ns"]
    rows = entries.filter("kind = 'file'").select("path", F.struct(*stat).alias("__was"))
    rows = rows.join(after.select("path", F.struct(*stat).alias("__is")), "path", "left").join(contents, "path", "left")
    whole = (F.col("__was") == F.col("__is")) & (F.octet_length("content") == F.col("__was.size"))
    state = F.when(~F.coalesce(whole, F.lit(False)), "Fault").when(F.col("binary"), "Binary").otherwise("Hashed")
    return rows.select("path", "__was.dev", "__was.ino", F.when(state != "Fault", F.col("content")).alias("content"), state.alias("state"))


def log_query(spark: SparkSession, folder: str, entry: dict) -> bool:
    """Append one record to the query log (JSON lines); a log that can't be written is no
    reason for a query to fail."""
    import json

    try:
        spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(folder)
    except Exception:  # noqa: BLE001
        return False
    return True


EVENT = "id string, seq long, event string, row string, status int"


def batch_events(request_id: str, rows: DataFrame, status: int = 0) -> DataFrame:
    """begin, one row event for each row (as JSON), and end with the status, in seq order."""
    spark = rows.sparkSession
    body = rows.select(F.lit(request_id).alias("id"), (F.monotonically_increasing_id() + 1).alias("seq"), F.lit("row").alias("event"), F.to_json(F.struct(*rows.columns)).alias("row"), F.lit(None).cast("int").alias("status"))
    ends = spark.createDataFrame([(request_id, 0, "begin", None, None), (request_id, 2**63 - 1, "end", None, status)], EVENT)
    return body.unionByName(ends)


def identities(spark: SparkSession, lines: list[str], key: int = 2) -> DataFrame:
    """id, name from passwd or group lines, the first line of an id wins."""
    seen: dict[int, str] = {}
    for line in lines:
        parts = line.split(":")
        if len(parts) > key and parts[key].isdigit():
            seen.setdefault(int(parts[key]), parts[0])
    return spark.createDataFrame(sorted(seen.items()), "id long, name string")


def batch_requests(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON-lines requests with an explicit schema; ``error`` tells what is wrong."""
    schema = "id string, op string, args array<string>, cwd string, limit long, capabilities array<string>, child_stdin string, start_unix_ns long"
    parsed = F.from_json(column, schema)
    known = ["search", "find", "grep", "status", "reload", "index", "roots-remove"]
    error = F.when(F.octet_length(column) > 1 << 20, "too-long").when(parsed.isNull() | parsed["op"].isNull(), "malformed").when(~parsed["op"].isin(known), "unknown-op").when(F.size(parsed["args"]) > 16384, "too-many-args")
    return lines.select(*(keep or []), parsed.alias("request"), error.alias("error"))

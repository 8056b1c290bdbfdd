"""Incremental maintenance: observations against the catalog, change log, overlay.

A snapshot is one row for each (parent, name) with the inode's identity and stat. An
observation has the same columns; ``covered`` lists directories whose listing is
complete, ``protected`` those that could not be read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = ("size", "mtime_s", "mtime_ns", "ctime_s", "ctime_ns")
IDENTITY = ("dev", "ino")
STAT = ("dev", "ino", "kind", *VERSION, "mode", "uid", "gid", "nlink", "target")


class Stale(ValueError):
    """An observation that can't be applied: overflow, another generation or policy."""


def check_generation(catalog: dict, observed: dict, overflow: bool = False, protected: bool = False) -> None:
    if overflow:
        raise Stale("the observation is incomplete")
    if observed["generation"] != catalog["generation"]:
        raise Stale("the observation is of another generation")
    if protected and (observed["policy"] != catalog["policy"] or observed["sniffer"] != catalog["sniffer"]):
        raise Stale("the policy changed while something is protected")


def canonical(observed: DataFrame) -> DataFrame:
    """One row for each (dev, ino): the first alias by (parent, name), and state Fault
    where aliases disagree on stat, content or target."""
    facts = F.struct(*[F.col(c) for c in ("kind", *VERSION, "target", "hash")])
    rows = observed.groupBy(*IDENTITY).agg(F.min_by(F.struct(*[F.col(c) for c in observed.columns if c not in IDENTITY]), F.struct("parent", "name")).alias("r"), F.count_distinct(F.to_json(facts)).alias("n"), F.count("*").alias("aliases"))
    state = F.when(F.col("n") > 1, "Fault").otherwise(F.col("r.state"))
    keep = [c for c in observed.columns if c not in (*IDENTITY, "state", "hash")]
    return rows.select(*IDENTITY, *[F.col(f"r.{c}").alias(c) for c in keep], state.alias("state"), F.when(F.col("n") == 1, F.col("r.hash")).alias("hash"), "aliases")


def diff(old: DataFrame, new: DataFrame, covered: DataFrame | None = None, protected: DataFrame | None = None) -> DataFrame:
    """kind (insert, update, delete, unchanged), parent, name: a full outer join on the
    edge. Edges that were not seen are deleted only in covered directories and never
    below protected ones."""
    same = [c for c in STAT if c in old.columns and c in new.columns]
    left = old.select("parent", "name", F.struct(*same).alias("__old"))
    right = new.select("parent", "name", F.struct(*same).alias("__new"))
    rows = left.join(right, ["parent", "name"], "full")
    kind = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__old") == F.col("__new"), "unchanged").otherwise(F.when(F.to_json("__old") == F.to_json("__new"), "unchanged").otherwise("update"))
    rows = rows.select("parent", "name", kind.alias("kind"))
    if covered is not None:
        rows = rows.join(covered.select(F.col("path").alias("parent"), F.lit(True).alias("__in")), "parent", "left").filter("kind != 'delete' or __in").drop("__in")
    if protected is not None:
        from siftwood.plans.find import ancestors

        shut = protected.select(F.col("path").alias("__shut"))
        path = F.concat("parent", F.lit("/"), "name")
        below = rows.select("parent", "name", F.explode(F.concat(ancestors(path), F.array(path))).alias("__shut")).join(shut, "__shut", "left_semi").select("parent", "name").distinct()
        rows = rows.join(below, ["parent", "name"], "left_anti")
    return rows


def diff_inodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind (insert, update, delete, unchanged), dev, ino: the same on the inodes, one row
    for each however many names it has. Aliases that disagree count as an update."""
    facts = [c for c in STAT if c not in IDENTITY and c in old.columns and c in new.columns]
    one = lambda df, name: df.groupBy(*IDENTITY).agg(F.min(F.to_json(F.struct(*facts))).alias(name), (F.min(F.to_json(F.struct(*facts))) != F.max(F.to_json(F.struct(*facts)))).alias(f"{name}_split"))
    rows = one(old, "was").join(one(new, "is"), list(IDENTITY), "full")
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").when((F.col("was") == F.col("is")) & ~F.col("was_split") & ~F.col("is_split"), "unchanged").otherwise("update")
    return rows.select(*IDENTITY, kind.alias("kind"))


def change_records(old: DataFrame, new: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """NamePut, NameDelete, InodePut and LinkPut records (kind, key, payload), sorted by a
    fixed key (a range-partitioned sort); a link's record comes only where its target changed."""
    edges = diff(old, new, covered)
    path = F.concat("parent", F.lit("/"), "name")
    names = edges.filter("kind in ('insert', 'delete')").select(F.when(F.col("kind") == "insert", "NamePut").otherwise("NameDelete").alias("kind"), path.alias("key"), F.lit(None).cast("string").alias("payload"))
    fresh = new.join(edges.filter("kind in ('insert', 'update')").select("parent", "name"), ["parent", "name"])
    inodes = fresh.select(F.lit("InodePut").alias("kind"), F.concat_ws(":", "dev", "ino").alias("key"), F.to_json(F.struct(*[c for c in STAT if c in new.columns])).alias("payload")).distinct()
    links = new.filter("kind = 'symlink'").join(old.filter("kind = 'symlink'").select("parent", "name", F.col("target").alias("__was")), ["parent", "name"], "left")
    links = links.filter(~F.col("target").eqNullSafe(F.col("__was"))).select(F.lit("LinkPut").alias("kind"), path.alias("key"), F.col("target").alias("payload"))
    return names.unionByName(inodes).unionByName(links).orderBy("kind", "key")


def latest(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last record of every key: an aggregation, which combines before it shuffles."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def overlay(base: DataFrame, log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The base with its log applied: latest records replace, deletes remove."""
    last = latest(log, key, seq)
    kept = base.join(last.select(key), key, "left_anti")
    columns = [c for c in base.columns]
    return kept.select(*columns).unionByName(last.filter("kind != 'delete'").select(*columns))


def compact(base: DataFrame, log: DataFrame, folder: str, key: str = "id", seq: str = "seq") -> str:
    """Write the overlay as the next version below ``folder``."""
    import uuid

    version = uuid.uuid4().hex
    overlay(base, log, key, seq).write.parquet(f"{folder}/{version}")
    publish(base.sparkSession, folder, version)
    return f"{folder}/{version}"


def published(spark: SparkSession, folder: str) -> Row | None:
    """number, version of the newest published version below ``folder``."""
    try:
        return spark.read.schema("number long, version string").json(f"{folder}/current").orderBy(F.desc("number"), "version").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Make a written version the newest one. Pointers are only added, never overwritten, so
    a crash at any moment leaves the version before in force."""
    last = published(spark, folder)
    number = 0 if last is None else last.number + 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").json(f"{folder}/current")


def append_log(log: DataFrame, folder: str) -> None:
    """Add records to a change log; readers see all of them or none."""
    log.write.mode("append").parquet(folder)


def needs_compaction(records: int, size: int, dirty_percent: float, dead_percent: float) -> bool:
    return size >= 64 << 20 or records >= 500_000 or dirty_percent >= 1 or dead_percent >= 5


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """Observed inodes with the old state, hash and document where nothing of the seven
    facts changed; faults are never carried."""
    facts = [*IDENTITY, *VERSION]
    known = old.filter("state != 'Fault'").select(*facts, F.col("state").alias("__state"), F.col("hash").alias("__hash"), F.col("doc_id").alias("__doc")).dropDuplicates(facts)
    rows = new.join(known, facts, "left")
    return rows.select(*new.columns, F.col("__state").alias("carried_state"), F.col("__hash").alias("carried_hash"), F.col("__doc").alias("carried_doc"), F.col("__state").isNotNull().alias("carried"))


def assign_documents(hashes: DataFrame, live: DataFrame, dormant: DataFrame, next_id: int, covered: bool = True) -> DataFrame:
    """hash, doc_id: a live document's id, else a dormant one's where the index covers
    it, else new ids in hash order from ``next_id``."""
    wanted = hashes.select("hash").distinct()
    rows = wanted.join(live.select("hash", F.col("doc_id").alias("a")), "hash", "left")
    again = dormant.select("hash", F.col("doc_id").alias("b")) if covered else dormant.select("hash", F.lit(None).cast("long").alias("b")).limit(0)
    rows = rows.join(again, "hash", "left").withColumn("known", F.coalesce("a", "b"))
    # numbers within hash ranges, then offsets of the ranges: no global sort in one task
    fresh = rows.filter("known is null").select("hash", F.substring(F.md5("hash"), 1, 3).alias("range"))
    sizes = fresh.groupBy("range").agg(F.count("*").alias("m"))
    offsets = sizes.select("range", (F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m")).alias("before"))
    number = F.row_number().over(W.partitionBy("range").orderBy("hash"))
    given = fresh.withColumn("n", number).join(offsets, "range").select("hash", (F.col("before") + F.col("n") - 1 + next_id).cast("long").alias("doc_id"))
    return rows.filter("known is not null").select("hash", F.col("known").cast("long").alias("doc_id")).unionByName(given)


def rename_pairs(events: DataFrame) -> DataFrame:
    """Renames from moved-from and moved-to events of one cookie."""
    a = events.filter("mask = 'moved_from'").select("cookie", F.concat("dir", F.lit("/"), "name").alias("old_path"))
    b = events.filter("mask = 'moved_to'").select("cookie", F.concat("dir", F.lit("/"), "name").alias("new_path"))
    return a.join(b, "cookie")


def repositories(work_trees: DataFrame) -> DataFrame:
    """Work trees that share a common directory, by its identity."""
    return work_trees.groupBy("common_dev", "common_ino").agg(F.sort_array(F.collect_set("dir")).alias("dirs"), F.count("*").alias("n"))

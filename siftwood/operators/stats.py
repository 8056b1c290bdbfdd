"""The catalog census: group counts, histograms, percentiles, duplicates, top lists."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kinds(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count("*").alias("n"))


def inode_counts(entries: DataFrame) -> DataFrame:
    special = F.col("kind").isin("fifo", "socket", "block", "character")
    n = lambda c: F.count(F.when(c, 1))
    return entries.agg(n(F.col("kind") == "file").alias("files"), n(F.col("kind") == "symlink").alias("symlinks"), n(special).alias("specials"), n(F.col("kind") == "dir").alias("dirs"))


def states(entries: DataFrame) -> DataFrame:
    return entries.filter("kind = 'file'").groupBy("state").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def extension(name: Column) -> Column:
    """Lower-case text behind the last dot; none where there is no dot but a leading one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def extensions(entries: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` extensions by number of files."""
    rows = entries.filter("kind = 'file'").groupBy(extension(F.col("name")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rows.orderBy(F.desc("files"), "ext").limit(top)


def bucket(value: Column) -> Column:
    """Bit length: 0 for 0, i for 2^(i-1) .. 2^i - 1."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("int")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(column).alias("total"))


#: Equal parts into which a range of values is cut while percentiles are looked for, and
#: how many different values one task may put in order.
PARTS, SORTED = 4096, 1 << 16


def percentiles(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """q, value at index round((n - 1) q) of the sorted column, halves away from zero.

    Values are counted first. Totals of log2 buckets (at most some 130 rows for the driver)
    tell which bucket holds an index; a bucket of more than SORTED different values is cut
    into PARTS ranges, again and again, so no task puts more than that in order."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))

    def totals(held: DataFrame, part: Column) -> list[Row]:
        return held.groupBy(part.alias("part")).agg(F.sum("n").alias("m"), F.count("*").alias("d"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("part").collect()

    def holder(parts: list[Row], before: int, index: int) -> tuple[Row, int]:
        for p in parts:
            if index < before + p.m:
                return p, before
            before += p.m
        raise AssertionError("an index lies in some part")

    first = totals(counts, bucket(F.abs(F.floor("value"))) * F.when(F.col("value") < 0, -1).otherwise(1))
    everything, marks = sum(p.m for p in first), []
    for q in shares if everything else ():
        index = math.floor((everything - 1) * q + 0.5)
        part, before = holder(first, 0, index)
        while part.d > SORTED:
            held = counts.filter((F.col("value") >= part.low) & (F.col("value") <= part.high))
            share = (F.col("value") - part.low) / (part.high - part.low) * PARTS
            part, before = holder(totals(held, F.least(F.lit(PARTS - 1), F.floor(share).cast("int"))), before, index)
        marks.append(F.struct(F.lit(q).alias("q"), F.lit(index).alias("index"), F.lit(before).alias("before"), F.lit(part.low).alias("low"), F.lit(part.high).alias("high")))
    if not marks:
        return counts.limit(0).select(F.lit(0.0).alias("q"), "value")
    near = F.filter(F.array(*marks), lambda w: (F.col("value") >= w["low"]) & (F.col("value") <= w["high"]))
    held = counts.select("value", "n", F.explode(near).alias("w"))
    within = W.partitionBy("w.q").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = held.withColumn("upto", F.col("w.before") + F.sum("n").over(within))
    return ranked.filter((F.col("upto") > F.col("w.index")) & (F.col("upto") - F.col("n") <= F.col("w.index"))).select("w.q", "value")


def hard_links(names: DataFrame) -> DataFrame:
    """Inodes with more than one name and their names beyond the first, by (dev, ino)."""
    rows = names.filter("kind = 'file'").groupBy("dev", "ino").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.agg(F.count("*").alias("inodes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_names"))


def content_hash(text: Column) -> Column:
    """128 bits of SHA-256, as lower-case hex."""
    return F.left(F.sha2(text, 256), F.lit(32))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contents held more than once: how many, holders and bytes beyond the first."""
    size = F.octet_length(text)
    rows = docs.select(content_hash(F.col(text)).alias("hash"), size.cast("long").alias("size")).groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n > 1")
    return rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_inodes"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("extra_bytes"))


def document_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each different content, with its smallest holder."""
    return docs.groupBy(content_hash(F.col(text)).alias("hash")).agg(F.min(key).alias("doc_id"), F.count("*").alias("refs"))


def dangling(references: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return references.join(docs.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))


def live_dead(ids: DataFrame, live: DataFrame) -> DataFrame:
    """live, dead, next_id over all ids ever given."""
    rows = ids.join(live.select("doc_id", F.lit(1).alias("__live")), "doc_id", "left")
    return rows.agg(F.count("__live").alias("live"), (F.count("*") - F.count("__live")).alias("dead"), (F.max("doc_id") + 1).alias("next_id"))


def subtree_counts(entries: DataFrame) -> DataFrame:
    """path, n: rows below each directory, by exploding every row's ancestors."""
    from siftwood.plans.find import ancestors

    return entries.filter("depth > 0").select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def budgets(log: DataFrame, catalog_rows: int) -> DataFrame:
    """Share of dirty and dead records of a change log, in percent of the catalog's rows."""
    dead = F.count(F.when(F.col("kind").like("%Delete"), 1))
    return log.agg(F.count("*").alias("records"), (100.0 * F.count_distinct("id") / max(1, catalog_rows)).alias("dirty_percent"), (100.0 * dead / max(1, catalog_rows)).alias("dead_percent"))


def as_json(table: DataFrame) -> DataFrame:
    return table.select(F.to_json(F.struct(*table.columns)).alias("value"))


def sample(rows: DataFrame, key: str, share: int) -> DataFrame:
    """About one row in ``share``, the same ones whenever it is asked."""
    return rows.filter(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % share == 0)


def pretty_bytes(n: Column) -> Column:
    """A number of bytes for people: whole bytes, else one decimal of a binary unit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        # tenths, halves up, in whole numbers
        tenths = F.floor((n * 10 + (1 << 10 * k - 1)) / F.lit(1 << 10 * k))
        out = F.when(n >= 1 << 10 * k, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def section_bytes(spark, folder: str, names: int) -> DataFrame:
    """section, bytes, bytes_per_name of a stored catalog's parts (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    inside = F.regexp_extract("path", re.escape(folder.rstrip("/")) + "/([^/]+)", 1)
    return files.groupBy(inside.alias("section")).agg(F.sum("length").alias("bytes")).withColumn("bytes_per_name", F.col("bytes") / max(1, names))

"""Ignore policy: gitignore lines as rows, decisions by precedence, level by level.

A rule row is (dir, band, line, regex, negate, dir_only). The band says which file a line
comes from; the highest band with a match decides, in it the closest directory, in one
file the last line. Excluded directories are not entered; the tool's own file may
re-include below them, which makes them traversed only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.patterns import _bracket, quote
from siftwood.plans.find import ancestors

#: Ignore files by rising precedence.
BANDS = {"global": 0, "exclude": 1, ".gitignore": 2, ".ignore": 3, ".rgignore": 4, ".siftignore": 5}
OWN = BANDS[".siftignore"]
SIZE_CAP = 8 << 20
DEFAULTS = [".git/", "node_modules/", ".venv/", "target/", ".next/", "result", ".cache/", "__pycache__/", ".direnv/"]
RULE = "dir string, band int, line int, regex string, negate boolean, dir_only boolean"


def compile_line(line: str) -> tuple[str, bool, bool] | None:
    """(regex over the path below the file's directory, negate, dir_only); None where a
    line says nothing. Without a slash before its end a pattern holds at any depth."""
    line = line.removesuffix("\r").removeprefix("﻿")
    if line.startswith("#"):
        return None
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    negate = line.startswith("!")
    line = line[1:] if negate else line
    dir_only = line.endswith("/")
    line = line[:-1] if dir_only else line
    if not line or line == "/":
        return None
    anchored = "/" in line
    parts = line.lstrip("/").split("/") if anchored else [line]
    out = "" if anchored else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                out += "" if out.endswith("[^/]*") and i and part[i - 1] == "*" else "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[":
                found = _bracket(part, i, True)
                if found is None:
                    return None
                out, i = out + found[0], found[1]
                continue
            elif c == "\\":
                if i + 1 == len(part):
                    return None
                i += 1
                out += quote(part[i])
            else:
                out += quote(c)
            i += 1
        out += "" if last else "/"
    return f"(?s)^{out}$", negate, dir_only


def rules(spark: SparkSession, files: list[tuple[str, str, list[str]]], root: str = "") -> DataFrame:
    """Rule rows from (directory, file name or band, lines)."""
    rows = []
    for folder, name, lines in files:
        for number, line in enumerate(lines, 1):
            if (found := compile_line(line)) is not None:
                rows.append((folder if BANDS[name] else root, BANDS[name], number, *found))
    return spark.createDataFrame(rows, RULE)


def read_rules(entries: DataFrame) -> DataFrame:
    """Rule rows of all ignore files among the entries of a walked tree (Spark's file
    sources pass hidden names over). The files are read where the tree is walked, by the
    executors; one that is gone by then has no rules."""
    own = F.col("name").isin(*(n for n in BANDS if n.startswith("."))) | F.col("path").endswith("/.git/info/exclude")

    def compiled(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                where, _, name = path.rpartition("/")
                # a work tree's own list holds from its top
                where = where.removesuffix("/.git/info") if name == "exclude" else where
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="\n") as lines:
                        text = lines.read()
                except OSError:
                    continue
                for number, line in enumerate(text.split("\n"), 1):
                    if (found := compile_line(line)) is not None:
                        rows.append((where, BANDS[name], number, *found))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RULE.split(", ")])

    return entries.filter((F.col("kind") == "file") & own).select("path").mapInArrow(compiled, RULE)


def verdicts(entries: DataFrame, rule_rows: DataFrame, work_trees: DataFrame | None = None) -> DataFrame:
    """path, hit_band, excluded: the deciding rule of every entry, from the rules of the
    directories above it (an equi join on ancestors, then the regex). Entries without
    a matching rule have nulls. ``work_trees`` (dir) are the tops of repositories: below
    one, .gitignore and exclude lines of directories above it don't count."""
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(ancestors(F.col("path")), lambda a: a), F.array("root")))
    rows = entries.select("path", "kind", F.explode(above).alias("dir"))
    joined = rows.join(rule_rows, "dir").filter((~F.col("dir_only") | (F.col("kind") == "dir")) & (F.col("path") != F.col("dir")))
    # the regex is a column of the rules, so it is matched by expression
    hits = joined.filter(F.expr("substring(path, length(dir) + 2) rlike regex"))
    if work_trees is not None:
        tops = entries.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("dir")).join(work_trees.select("dir"), "dir").groupBy("path").agg(F.max(F.length("dir")).alias("top"))
        hits = hits.join(tops, "path", "left").filter(~F.col("band").isin(BANDS["exclude"], BANDS[".gitignore"]) | F.col("top").isNull() | (F.length("dir") >= F.col("top")))
    rank = F.struct("band", F.length("dir").alias("depth"), "line")
    best = hits.groupBy("path").agg(F.max_by(F.struct("band", "negate"), rank).alias("b"))
    return entries.select("path").join(best, "path", "left").select("path", F.col("b.band").alias("hit_band"), (~F.col("b.negate")).alias("excluded"))


def decide(entries: DataFrame, rule_rows: DataFrame, size_cap: int = SIZE_CAP, work_trees: DataFrame | None = None) -> DataFrame:
    """path, decision: skip, descend, traverse, too-large, symlink, special, index or
    unvisited (below a directory that is not entered).

    Rules outside the tool's own file count only where no excluded directory lies above
    their file; an excluded directory is traversed where an own negation may hold below.
    """
    found = entries.join(verdicts(entries, rule_rows, work_trees), "path")
    out = F.coalesce("excluded", F.lit(False))
    own = rule_rows.filter((F.col("band") == OWN) & F.col("negate")).select("dir").distinct()
    opens = found.filter(out & (F.col("kind") == "dir")).select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.array("root"))).alias("dir")).join(own, "dir", "left_semi").select("path").distinct().withColumn("opens", F.lit(True))
    found = found.join(opens, "path", "left")
    shut = found.filter(out & (F.col("kind") == "dir")).select(F.col("path").alias("above"), F.coalesce("opens", F.lit(False)).alias("opens"))
    under = found.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(shut, "above").groupBy("path").agg(F.min("opens").alias("opened"))
    rows = found.join(under, "path", "left")
    included_again = (F.col("hit_band") == OWN) & ~F.col("excluded")
    decision = (
        F.when(F.col("opened") == F.lit(False), "unvisited")
        .when((F.col("opened") == F.lit(True)) & ~F.coalesce(included_again, F.lit(False)), F.when(F.col("kind") == "dir", "traverse").otherwise("skip"))
        .when(out & (F.col("kind") == "dir"), F.when(F.col("opens"), "traverse").otherwise("skip"))
        .when(out, "skip")
        .when(F.col("kind") == "dir", "descend")
        .when(F.col("kind") == "symlink", "symlink")
        .when(F.col("kind") != "file", "special")
        .when(F.col("size") > size_cap, "too-large")
        .otherwise("index")
    )
    return rows.select("path", decision.alias("decision"), F.coalesce(included_again & F.col("path").rlike(r"/\.[^/]+$"), F.lit(False)).alias("revealed"))


def fingerprint(rule_rows: DataFrame) -> DataFrame:
    """One hash over all rules: a policy change shows as another value."""
    return rule_rows.agg(F.sum(F.xxhash64(*rule_rows.columns).cast("decimal(38,0)")).alias("policy"))

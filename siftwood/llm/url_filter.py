"""URL verdicts: rules first, gradient-boosted trees on lexical features otherwise.

Features of a URL are cut into a few bins each: length, depth, digit ratio, entropy,
parameters, hyphens, labels of the host, and two suffix statistics, the block rate of the
host's suffix and that of the suffix with the path's first segment. A labelled URL's
rates come from the other FOLDS - 1 folds (by its hash), so its own label and its copies
never reach its features; a new URL's come from all. Labelled
URLs are counted by their bins in one aggregation over all rows; there are at most
the product of the bins of such cells, however many URLs. The trees are boosted on the
weighted cells with the logistic loss and come back as CASE expressions, so judging
is a projection of the scan.

Edge cases: null URLs and those without ``://`` have an empty host and path; no rule
fits them and the trees judge them by their features. Without a labelled URL, or with
labels of one kind only, the verdict is that kind (allow when there is none).
Repeated URLs are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a host holds for its subdomains too, a path is a prefix.
Rule = tuple[str, str, str]
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Inner edges of each feature's bins; a value's bin is how many edges it reaches.
EDGES: dict[str, tuple[float, ...]] = {
    "length": (25, 40, 60),
    "depth": (2, 3, 5),
    "digits": (0.06, 0.12, 0.25),
    "entropy": (3.7, 4.1),
    "parameters": (1, 2),
    "hyphens": (1,),
    "labels": (3, 4),
    "suffix": (0.05, 0.2, 0.4, 0.6, 0.9),
    "section": (0.05, 0.2, 0.4, 0.6, 0.9),
}
#: Parts of the labelled URLs whose suffix statistics leave their own part out.
FOLDS = 4
RATES = ("suffix", "section")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of a host (all of it where it has fewer)."""
    return F.substring_index(host, ".", -2)


def section_of(suffix: Column, path: Column) -> Column:
    """The suffix and the path's first segment, to its first digit."""
    return F.concat(suffix, F.lit("/"), F.regexp_extract(path, "^/([^/0-9]*[0-9]?)", 1))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text."""
    n = F.length(text)

    def term(acc: Column, c: Column) -> Column:
        k = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return acc + F.when(k > 0, -k * F.log2(k)).otherwise(0.0)

    characters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(characters, F.lit(0.0), term)


def features(url: Column, host: Column, path: Column, suffix_rate: Column, section_rate: Column) -> dict[str, Column]:
    text = F.lower(F.coalesce(url, F.lit("")))
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "length": F.length(text),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digits": (F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))) / n,
        "entropy": _entropy(text),
        "parameters": F.when(text.contains("?"), 1 + F.length(F.substring_index(text, "?", -1)) - F.length(F.replace(F.substring_index(text, "?", -1), F.lit("&"), F.lit("")))).otherwise(0),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "labels": F.when(host == "", 0).otherwise(1 + F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))),
        "suffix": suffix_rate,
        "section": section_rate,
    }


def _counts(known: DataFrame, name: str) -> DataFrame:
    """For each value of the column ``name`` the blocked and all labelled URLs, in total
    (b, n) and by fold (b0, n0, ...)."""
    blocked = F.col("blocked").cast("int")
    parts = [x for k in range(FOLDS) for x in (F.sum(F.when(F.col("fold") == k, blocked).otherwise(0)).alias(f"{name}_b{k}"), F.sum((F.col("fold") == k).cast("int")).alias(f"{name}_n{k}"))]
    return known.groupBy(name).agg(F.sum(blocked).alias(f"{name}_b"), F.count("*").alias(f"{name}_n"), *parts)


def _rate(name: str, prior: float, smoothing: float, own: bool) -> Column:
    """The smoothed block rate of a value, without the row's own fold if it is labelled."""
    b, n = F.coalesce(f"{name}_b", F.lit(0)), F.coalesce(f"{name}_n", F.lit(0))
    if own:
        pick = lambda part: reduce(lambda rest, k: F.when(F.col("fold") == k, F.col(f"{name}_{part}{k}")).otherwise(rest), range(FOLDS), F.lit(0))
        b, n = b - pick("b"), n - pick("n")
    return (b + prior * smoothing) / (n + smoothing)


def _binned(rows: DataFrame, rates: list[Column], *keep: str) -> DataFrame:
    """The kept columns and the bin of every feature, of rows with url, host, path."""
    values = features(F.col("url"), F.col("host"), F.col("path"), *rates)
    rows = rows.select(*keep, *[v.alias(name) for name, v in values.items()])
    # computed once above, compared with every edge here
    return rows.select(*keep, *[reduce(lambda a, e: a + F.when(F.col(name) >= e, 1).otherwise(0), edges, F.lit(0)).alias(name) for name, edges in EDGES.items()])  # noqa: B023


def _leaf(cells: list[tuple], grads: list[tuple[float, float]], rows: list[int], depth: int, shrink: float, floor: float):
    """A regression tree on binned cells: (feature, edge, low, high) or a number."""
    g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
    best, gain = None, 1e-6
    if depth:
        for f in range(len(EDGES)):
            sums: dict[int, list[float]] = {}
            for i in rows:
                s = sums.setdefault(cells[i][f], [0.0, 0.0])
                s[0] += grads[i][0]
                s[1] += grads[i][1]
            lg = lh = 0.0
            for edge in sorted(sums)[:-1]:
                lg, lh = lg + sums[edge][0], lh + sums[edge][1]
                if min(lh, h - lh) < floor:
                    continue
                value = lg**2 / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g**2 / (h + 1)
                if value > gain:
                    best, gain = (f, edge), value
    if best is None:
        return -shrink * g / (h + 1)
    f, edge = best
    low, high = [i for i in rows if cells[i][f] <= edge], [i for i in rows if cells[i][f] > edge]
    return f, edge, _leaf(cells, grads, low, depth - 1, shrink, floor), _leaf(cells, grads, high, depth - 1, shrink, floor)


def _value(tree, cell) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list[tuple], block: list[int], allow: list[int], rounds: int = 20, depth: int = 3, shrink: float = 0.3, floor: float = 1.0) -> tuple[float, list]:
    """(bias, trees) fitted to weighted cells: how many rows of each are blocked, allowed."""
    total = sum(block), sum(allow)
    if not total[0] or not total[1]:
        return (20.0 if total[0] else -20.0), []
    bias = math.log(total[0] / total[1])
    score, trees = [bias] * len(cells), []
    for _ in range(rounds):
        grads = []
        for s, p, n in zip(score, block, allow, strict=True):
            q = 1 / (1 + math.exp(-s))
            grads.append(((p + n) * q - p, (p + n) * q * (1 - q)))
        tree = _leaf(cells, grads, list(range(len(cells))), depth, shrink, floor)
        trees.append(tree)
        score = [s + _value(tree, c) for s, c in zip(score, cells, strict=True)]
    return bias, trees


def _as_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, edge, low, high = tree
    return F.when(F.col(list(EDGES)[f]) <= edge, _as_column(low)).otherwise(_as_column(high))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None, smoothing: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees) of every URL.

    ``labelled`` has url string, blocked boolean; without it the URLs that a rule
    decides are the labelled ones.
    """

    def parsed(rows: DataFrame, *keep: str) -> DataFrame:
        rows = rows.select(*keep, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("suffix", suffix_of(F.col("host")))
        return rows.withColumn("section", section_of(F.col("suffix"), F.col("path")))

    rows = parsed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "page_id")
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("fixed", fixed)
    if labelled is None:
        known = rows.filter("fixed is not null").select("url", "host", "path", *RATES, (F.col("fixed") == "block").alias("blocked"))
    else:
        known = parsed(labelled.filter("blocked is not null").select(F.col("url").cast("string").alias("url"), "blocked"), "blocked")
    known = known.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    # as many rows as there are suffixes and sections; the joins are the planner's choice
    counts = {name: _counts(known, name) for name in RATES}
    total = known.agg(F.avg(F.col("blocked").cast("double"))).first()[0]
    prior = 0.5 if total is None else total

    def joined(df: DataFrame) -> DataFrame:
        for name, table in counts.items():
            df = df.join(table, name, "left")
        return df

    rates = lambda own: [_rate(name, prior, smoothing, own) for name in RATES]
    cells = _binned(joined(known), rates(True), "blocked").groupBy(*EDGES).agg(F.sum(F.col("blocked").cast("int")).alias("b"), F.sum((~F.col("blocked")).cast("int")).alias("a"))
    counted = sorted(cells.collect())
    bias, trees = boost([tuple(r[: len(EDGES)]) for r in counted], [r.b for r in counted], [r.a for r in counted]) if counted else (-20.0, [])
    score = reduce(lambda a, t: a + _as_column(t), trees, F.lit(bias))
    out = _binned(joined(rows), rates(False), "page_id", "host", "path", "rule", "fixed").withColumn("score", 1 / (1 + F.exp(-score)))
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("fixed"), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")

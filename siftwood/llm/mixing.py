"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree domain - language - source. At every node it is poured
into the children by weight up to their capacity (tokens times max_epochs); what a
child can't take goes to its siblings first, and only what all of them can't take stays
with the ancestors' other children. A leaf then takes whole epochs of its documents and
the prefix, in tokens, of one more epoch, whose order is seeded by epoch and document.

The prefix needs no sort of a leaf: documents fall into 4096 ranges of their order key,
ranges are summed, and only the range in which the prefix ends is ordered by document.

Edge cases: null text has no tokens; a null language is the leaf ``und``, a null source
``unknown``; rows of one id take equal places in the order. An empty table gives no row.
A budget above all capacities fills every leaf. Weights are positive integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.llm.common import checkpoint, renamed, text_or_empty

DOMAINS = {"web": 5, "books": 3, "code": 2, "other": 1}
LANGS = {"en": 6, "de": 2, "fr": 2, "es": 1}
TREE = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source by the number at its end."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,6})$", 1), F.lit("999999")).cast("int")
    return F.when(number < 5, "web").when(number < 12, "books").when(number.isNotNull(), "code").otherwise("other")


def _weight(key: Column, weights: dict[str, int], default: int = 1) -> Column:
    return reduce(lambda rest, kv: F.when(key == kv[0], kv[1]).otherwise(rest), weights.items(), F.lit(default)).cast("long")


def pour(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Budgets of the children (parents, child, capacity, weight, budget of the parent):
    water-filling with whole numbers, the column budget becomes the child's."""
    group = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity") / F.col("weight"), child)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    full = F.col("capacity") * rest <= (F.col("budget") - before) * F.col("weight")
    rows = children.withColumn("__full", full)
    taken = F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(group), F.lit(0))
    thirsty = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(group)
    rows = rows.withColumn("__taken", taken).withColumn("__thirsty", thirsty)
    share = F.expr("(budget - __taken) * weight div __thirsty")
    return rows.withColumn("budget", F.when(F.col("__full"), F.col("capacity")).otherwise(F.least("capacity", share))).drop("__full", "__taken", "__thirsty")


def leaf_budgets(totals: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """domain, lang, source, tokens, budget of every leaf of ``totals`` (... tokens)."""
    leaves = totals.withColumn("capacity", F.col("tokens") * max_epochs)
    # the whole budget, from the few nodes below the root
    whole = F.floor(F.expr(f"sum(capacity) over (partition by 0) div {max_epochs}").cast("double") * budget_share).cast("long")
    level = None
    for depth, name in enumerate(TREE):
        parents = list(TREE[:depth])
        children = leaves.groupBy(*TREE[: depth + 1]).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(name), weights.get(name, {})))
        above = children.withColumn("budget", whole) if level is None else children.join(level.select(*parents, "budget"), parents)
        level = pour(above, parents, name)
    return level.select(*TREE, "budget").join(leaves.select(*TREE, "tokens"), list(TREE))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", budget_share: float = 0.6, max_epochs: int = 4, seed: str = "mix-1", weights: dict[str, dict[str, int]] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies (whole epochs), extra_tokens (of the
    last, partial epoch) and tokens of every row."""
    weights = weights or {"domain": DOMAINS, "lang": LANGS}
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("unknown"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), source.alias("source"), F.regexp_count(text_or_empty(F.col(text_col)), F.lit(WORD)).cast("long").alias("n_tokens"), *extra)
    docs = checkpoint(docs)
    leaves = leaf_budgets(docs.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), budget_share, max_epochs, weights)
    leaves = checkpoint(leaves.select(*TREE, F.expr("coalesce(budget div nullif(tokens, 0), 0)").alias("copies"), F.expr("coalesce(budget % nullif(tokens, 0), 0)").alias("rest")))
    key = F.md5(F.concat_ws(":", F.lit(seed), (F.col("copies") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    docs = docs.join(leaves, list(TREE)).withColumn("__key", key).withColumn("__range", F.substring("__key", 1, 3))
    ranges = docs.groupBy(*TREE, "__range").agg(F.sum("n_tokens").alias("__sum"))
    order = W.partitionBy(*TREE).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(order), F.lit(0)))
    docs = docs.join(ranges, [*TREE, "__range"])
    inside = F.col("__before") + F.col("__sum") <= F.col("rest")
    ends = ~inside & (F.col("__before") < F.col("rest"))
    line = W.partitionBy(*TREE).orderBy("__key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    sure = docs.filter(~ends).withColumn("extra_tokens", F.when(inside, F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    at = F.col("rest") - F.col("__before") - F.coalesce(F.sum("n_tokens").over(line), F.lit(0))
    last = docs.filter(ends).withColumn("extra_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), at)).cast("long"))
    out = sure.unionByName(last)
    return out.select("doc_id", *TREE, "n_tokens", "copies", "extra_tokens", (F.col("copies") * F.col("n_tokens") + F.col("extra_tokens")).alias("tokens"), *extra)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that take part, with domain, n_tokens, copies, extra_tokens and
    tokens, which replace columns of these names. Rows with one id and text share the
    first one's place."""
    added = ["domain", "n_tokens", "copies", "extra_tokens", "tokens"]
    df = df.drop(*added)
    plain, names = renamed(df)
    check = F.xxhash64(text_or_empty(F.col(names[text_col])))
    wanted = plain.select(F.col(names[id_col]).alias("doc_id"), F.col(names[text_col]).alias("text"), F.col(names["lang"]).alias("lang"), F.col(names["source"]).alias("source"), check.alias("__check"))
    chosen = plan(wanted, extra=("__check",), **options).filter("tokens > 0")
    chosen = chosen.dropDuplicates(["doc_id", "__check"]).select(F.col("doc_id").alias("__id"), "__check", *added)
    rows = plain.withColumn("__own", check)
    same = F.col(names[id_col]).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__check"))
    return rows.join(chosen.hint("shuffle_hash"), same).select(*plain.columns, *added).toDF(*df.columns, *added)


def _sql_pour(source: str, parents: str, child: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""
    SELECT * REPLACE (CASE WHEN full_ THEN capacity ELSE least(capacity, (budget - taken) * weight // thirsty) END AS budget) FROM (
      SELECT *, (coalesce(sum(CASE WHEN full_ THEN capacity END) OVER ({by}), 0))::BIGINT AS taken, (sum(CASE WHEN NOT full_ THEN weight END) OVER ({by}))::BIGINT AS thirsty FROM (
        SELECT *, capacity::HUGEINT * sum(weight) OVER ({by} ORDER BY capacity / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                  <= (budget - coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS full_
        FROM ({source})))"""


def sql(budget_share: float = 0.6, max_epochs: int = 4, seed: str = "mix-1") -> str:
    """The same plan over ``documents`` in DuckDB's SQL."""
    weigh = lambda name, known: "(CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in known.items()) + " ELSE 1 END)::BIGINT"
    one = f"SELECT domain, sum(capacity)::BIGINT AS capacity, {weigh('domain', DOMAINS)} AS weight, (SELECT floor(sum(tokens)::DOUBLE * {budget_share})::BIGINT FROM leaves) AS budget FROM leaves GROUP BY domain"
    two = f"SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, {weigh('l.lang', LANGS)} AS weight, any_value(d.budget)::BIGINT AS budget FROM leaves l JOIN l1 d USING (domain) GROUP BY l.domain, l.lang"
    three = "SELECT l.domain, l.lang, l.source, l.capacity, 1::BIGINT AS weight, d.budget::BIGINT AS budget FROM leaves l JOIN l2 d USING (domain, lang)"
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, n_tokens, CASE WHEN number < 5 THEN 'web' WHEN number < 12 THEN 'books' WHEN number IS NOT NULL THEN 'code' ELSE 'other' END AS domain
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
               try_cast(nullif(regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,6}})$', 1), '') AS INT) AS number FROM documents)),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS capacity FROM docs GROUP BY ALL),
l1 AS ({_sql_pour(one, '', 'domain')}),
l2 AS ({_sql_pour(two, 'domain', 'lang')}),
l3 AS ({_sql_pour(three, 'domain, lang', 'source')}),
parts AS (SELECT l.domain, l.lang, l.source, coalesce(l3.budget // nullif(l.tokens, 0), 0)::BIGINT AS copies, coalesce(l3.budget % nullif(l.tokens, 0), 0)::BIGINT AS rest
          FROM leaves l JOIN l3 USING (domain, lang, source)),
keyed AS (SELECT d.*, copies, rest, md5('{seed}:' || (copies + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM docs d JOIN parts USING (domain, lang, source)),
placed AS (SELECT *, greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS extra_tokens FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, copies, extra_tokens, (copies * n_tokens + extra_tokens)::BIGINT AS tokens FROM placed
"""

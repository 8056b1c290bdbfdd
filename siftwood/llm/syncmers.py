"""Document fingerprints of closed syncmers over words.

Tokens are runs of letters and digits (single characters in scripts without spaces),
lower-cased, with K - 1 marks for nothing on either side of the text. A k-mer of K tokens
is a closed syncmer when the smallest of its s-mers (S tokens) is its first or last one.
Whether a k-mer is chosen depends on nothing outside it, so equal passages give equal
anchors wherever they stand; of K - S neighbouring k-mers one at least is chosen, so
every text with a token has an anchor. The fingerprint is the whole set of a text's
anchor hashes, and two fingerprints' likeness the exact Jaccard similarity of their sets.
anchors() gives the anchors with their positions.

Edge cases: null text counts as empty. A text without tokens but not empty gives a hash
of itself; the empty text has the empty fingerprint. Two empty fingerprints have likeness
1, an empty and another one 0. Equal texts have equal fingerprints. Hashes have 32 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.llm.common import text_or_empty
from siftwood.llm.spans import let

K, S = 5, 2
TOKEN = r"[A-Za-z0-9\u0080-⹿]+|[⺀-￿]|[^\x00-\x7F]"
#: The hash of the marks around a text.
EDGE = 0x5EED
#: Rows aimed at in one block of neighbours, and the bounds on the number of blocks.
BLOCK_ROWS, SEGMENTS, SUB_BLOCKS = 512, 256, 256
FIRST_ID = -(2**63)


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _tokens(text: Column) -> Column:
    """Hashes of a text's tokens between the marks; none for a text without tokens."""
    h = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.hash(t))
    marks = F.array(*[F.lit(EDGE)] * (K - 1))
    return let(h, lambda x: F.when(F.size(x) > 0, F.concat(marks, x, marks)).otherwise(x))


def _windows(df: DataFrame, keep: list[str], hashes: Column) -> DataFrame:
    """keep and __z: the four s-mers (a, b, c, d) of every k-mer in order. Each step is a
    projection of its own, so that no array is computed more than once for a row."""
    df = df.select(*keep, hashes.alias("__h"))
    smers = F.zip_with("__h", _shifted(F.col("__h"), 1), lambda a, b: F.when(b.isNotNull(), F.hash(a, b)))
    df = df.select(*keep, F.slice(smers, 1, F.greatest(F.size("__h") - 1, F.lit(0))).alias("__m"))
    m = F.col("__m")
    return df.select(*keep, F.arrays_zip(m.alias("a"), _shifted(m, 1).alias("b"), _shifted(m, 2).alias("c"), _shifted(m, 3).alias("d")).alias("__z"))


def _is_closed(z: Column) -> Column:
    # incomplete windows at the end have a null d, which no comparison keeps
    return z["d"].isNotNull() & (F.least(z["a"], z["d"]) <= F.least(z["b"], z["c"]))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: the sorted syncmer hashes of a text that is not null."""
    keep = df.columns
    df = _windows(df, keep, _tokens(F.col(text_col)))
    few = F.when(F.length(text_col) > 0, F.array(F.hash(F.col(text_col)))).otherwise(F.array().cast("array<int>"))
    kmers = F.transform(F.filter("__z", _is_closed), lambda z: F.hash(z["a"], z["c"], z["d"]))
    return df.select(*keep, F.when(F.size("__z") > 0, F.sort_array(F.array_distinct(kmers))).otherwise(few).alias(out))


def printed(fingerprint: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def _blocks(ids: DataFrame) -> tuple[Column, int]:
    """(block number of column __id, number of blocks): ranges of ids, at most
    SEGMENTS x SUB_BLOCKS, of about BLOCK_ROWS rows where ids are spread evenly
    between the SEGMENTS quantiles."""
    marks = [k / SEGMENTS for k in range(SEGMENTS)]
    found = ids.agg(F.count("*").alias("n"), F.percentile_approx("__id", marks, 20_000).alias("q"), F.max("__id").alias("top")).first()
    edges = sorted({*(found.q or [0])})
    sub = min(SUB_BLOCKS, max(1, math.ceil(found.n / (SEGMENTS * BLOCK_ROWS))))
    low = F.array(*[F.lit(e) for e in edges])
    high = F.array(*[F.lit(float(e)) for e in [*edges[1:], (found.top or 0) + 1]])
    own = F.greatest(F.size(F.filter(low, lambda e: e <= F.col("__id"))), F.lit(1))

    def number(k: Column) -> Column:
        begin = F.element_at(low, k).cast("double")
        share = (F.col("__id").cast("double") - begin) / F.greatest(F.element_at(high, k) - begin, F.lit(1.0)) * sub
        return (k - 1) * sub + F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.floor(share).cast("int")))

    return let(own, number), len(edges) * sub


def with_next(df: DataFrame, id_col: str, columns: list[str], order: list[str], then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with next_<column>: the columns of the next row in descending id (ties in
    ascending ``order``; null ids last), the first row's after the last row. ``then`` adds
    columns behind the exchange of the rows, which have to travel no more.

    Neighbours are found inside blocks of ids, so no task sorts the whole table. The
    rows of a block's highest id are sent to the block above as well, as guests behind
    its last row; the table of those ids has one row for a block and is bounded.
    """
    rows = df.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)))
    number, _ = _blocks(rows.select("__id"))
    tops = rows.select("__id", number.alias("__block")).groupBy("__block").agg(F.max("__id").alias("__id"))
    line = W.orderBy("__block")
    above = F.coalesce(F.lead("__block").over(line), F.first("__block").over(line))
    tops = F.broadcast(tops.select("__id", above.alias("__above")))
    places = F.array(F.struct(F.col("__block").alias("block"), F.lit(False).alias("guest")), F.struct(F.col("__above").alias("block"), F.lit(True).alias("guest")))
    own = F.array(F.struct(F.col("__block").alias("block"), F.lit(False).alias("guest")))
    sent = rows.withColumn("__block", number).join(tops, "__id", "left")
    sent = sent.select(*df.columns, "__id", F.explode(F.when(F.col("__above").isNull(), own).otherwise(places)).alias("__place"))
    sent = sent.select(*df.columns, "__id", F.col("__place.block").alias("__block"), F.col("__place.guest").alias("__guest")).repartition("__block")
    if then is not None:
        sent = then(sent)
    w = W.partitionBy("__block").orderBy("__guest", F.desc("__id"), *order)
    return sent.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("not __guest").drop("__id", "__block", "__guest")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half replaced by
    the start of the next document's), with their likeness; see op6 in the README."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = with_next(rows, "doc_id", ["text", "own"], ["text"], lambda sent: with_fingerprint(sent, "text", "own"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("following"))
    rows = with_fingerprint(rows, "edited", "changed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def anchors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position (of the first token, from 0; before the text it is negative) and
    hash of every closed syncmer: the anchors for positional matching."""
    rows = _windows(df.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")), ["doc_id"], _tokens(F.col("text")))
    rows = rows.select("doc_id", F.posexplode("__z").alias("position", "z")).filter(_is_closed(F.col("z")))
    return rows.select("doc_id", (F.col("position") - (K - 1)).alias("position"), F.hash("z.a", "z.c", "z.d").alias("hash"))


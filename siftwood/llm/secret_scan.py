"""Secrets: base patterns and character Markov models.

Base spans are assignments, access keys and long hexadecimal strings. The method
adds tokens that look random: every token of LEAST characters or more is scored by the
likelihood ratio of two character Markov models (bigrams), one of random strings, one
of ordinary identifiers. Both are trained from labelled samples: tokens with a flag.
Where none are given, SYNTHETIC random strings of the usual alphabets, drawn with a fixed
seed, are the secrets, together with the values of base matches; a bounded sample of the
texts' words, also in capitals, joined to identifiers and with numbers, and numbers are
ordinary. Only the bigram counts, at most 2 x 69 x 69 numbers, reach the driver; the
models come back as constant arrays, so scoring stays in the JVM.

Edge cases: null text counts as empty. Without samples of a class its model is
uniform. Repeated rows and ids stand for themselves. An empty table gives no row.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm.common import checkpoint, text_or_empty
from siftwood.llm.spans import apart, joined, matches, tagged

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
#: Characters of the shortest token that is scored.
LEAST = 16
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % LEAST
#: Longer runs of letters are no words to learn from; they are scored all the same.
WORD = r"(?<![\p{L}\p{N}_])[A-Za-z]{3,20}+(?![\p{L}\p{N}_])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
REPEATS = 256
#: Bounds of the samples of ordinary words: rows (about) and words.
SAMPLE_ROWS, SAMPLE_WORDS = 4000, 50_000
#: Random strings that are drawn of each alphabet.
SYNTHETIC = 400
ALPHABETS = {"base62": ALPHABET[:62], "base64": ALPHABET[:64], "url": ALPHABET[:62] + "_-", "lower": ALPHABET[26:62], "upper": ALPHABET[:26] + ALPHABET[52:62], "letters": ALPHABET[:52], "base32": ALPHABET[:26] + "234567", "hex": "0123456789abcdef"}


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind of a text that is not null, in order."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= 6)
    return {"assign": tagged("assign", assign), "access": tagged("access", matches(text, ACCESS, text.contains("AKIA"))), "hex": tagged("hex", matches(text, HEX))}


def _codes(token: Column) -> Column:
    """Numbers 0..SIZE-1 of the characters of a token."""
    characters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(characters, lambda c: F.instr(F.lit(ALPHABET), c))


def _bigrams(token: Column) -> Column:
    codes = _codes(token)
    rest = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, rest), F.slice(codes, 2, rest), lambda a, b: a * SIZE + b)


def train(labelled: DataFrame) -> list[float]:
    """Log likelihood ratios of all bigrams from (token, secret) rows."""
    pairs = labelled.filter("token is not null and secret is not null").select("secret", F.explode(_bigrams(F.col("token"))).alias("pair")).filter("pair is not null")
    counts = {True: [0] * SIZE**2, False: [0] * SIZE**2}
    for r in pairs.groupBy("secret", "pair").count().collect():
        counts[r.secret][r.pair] = r["count"]

    def log_model(count: list[int], uniform: float, backing: float = 5.0, prior: float = 0.5) -> list[float]:
        # rare contexts fall back on the frequencies of the characters themselves
        single = [sum(count[b::SIZE]) + prior for b in range(SIZE)]
        whole, out = sum(single), []
        for a in range(SIZE):
            row = count[a * SIZE : (a + 1) * SIZE]
            total = sum(row) + backing
            out += [math.log((1 - uniform) * (n + backing * single[b] / whole) / total + uniform / SIZE) for b, n in enumerate(row)]
        return out

    # random strings may use any alphabet: half of their model stays uniform
    random, ordinary = log_model(counts[True], 0.5), log_model(counts[False], 0.05)
    return [r - o for r, o in zip(random, ordinary, strict=True)]


def ratio(token: Column, weights: list[float]) -> Column:
    """Mean log likelihood ratio of a token's bigrams (null for one character). What a token
    repeats counts once, over REPEATS bigrams at most: a run of one letter isn't random."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    found = F.transform(F.array_distinct(_bigrams(token)), lambda p: F.element_at(table, (p + 1).cast("int")))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.least(F.length(token) - 1, F.lit(REPEATS)), F.lit(0))


def random_strings(seed: int, each: int = SYNTHETIC) -> list[str]:
    """Seeded random strings of 16 to 48 characters, ``each`` of every alphabet."""
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(LEAST, 48))) for letters in ALPHABETS.values() for _ in range(each)]


def _ordinary(df: DataFrame, text_col: str, n: int) -> DataFrame:
    """Ordinary identifiers (token) made of a reproducible sample of words, from about
    SAMPLE_ROWS rows chosen by hash: each as it is, in capitals, doubled in
    snake, kebab and camel case and as a path, and with a number; and numbers alone."""
    text = text_or_empty(F.col(text_col))
    keep = max(1, n // SAMPLE_ROWS)
    rows = df.select(text.alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(keep)) == 0)
    found = F.array_distinct(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    words = rows.select(F.explode(found).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS)
    number = F.pmod(F.xxhash64("w", F.lit(1)), F.lit(100_000)).cast("string")
    long_number = F.regexp_replace(F.concat(F.xxhash64("w", F.lit(2)).cast("string"), F.xxhash64("w", F.lit(3)).cast("string")), "-", "")
    two = lambda joint: F.concat(F.lower("w"), F.lit(joint), F.lower("w"))
    forms = F.array(F.col("w"), F.col("w"), F.upper("w"), F.initcap("w"), two("_"), two("-"), two("/"), F.concat(F.initcap("w"), F.initcap("w")), F.concat(F.lower("w"), F.lit("_"), number), F.concat(F.col("w"), number), F.concat(F.upper("w"), F.lit("_"), F.upper("w")), F.concat(F.lit("--"), F.lower("w"), F.lit("=")), F.lit("=-=-__--=="), long_number)
    return words.select(F.explode(forms).alias("token"))


def find(df: DataFrame, key: list[str], text_col: str = "text", labelled: DataFrame | None = None, threshold: float = 0.55) -> DataFrame:
    """The key columns, base (tagged base spans by start, then kind) and random (spans
    that the models add, by start) of every row.

    ``labelled`` has token string, secret boolean; a token counts as random where its
    mean log likelihood ratio exceeds ``threshold`` (nats a character).
    """
    rows = df.select(*key, text_or_empty(F.col(text_col)).alias("__text"))
    rows = rows.select(*key, *[s.alias(f"__{k}") for k, s in base_spans(F.col("__text")).items()], tagged("random", matches(F.col("__text"), TOKEN)).alias("__tokens"))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(F.concat(*[F.col(f"__{k}") for k in KINDS]), lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text"))))
    rows = rows.select(*key, F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("base"), "__tokens")
    rows = checkpoint(rows.select(*key, "base", apart(F.col("__tokens"), F.col("base")).alias("__tokens")))
    if labelled is None:
        value = F.when(F.col("b.kind") == "assign", F.regexp_extract("b.text", ASSIGN, 1)).otherwise(F.col("b.text"))
        secret = rows.select(F.explode("base").alias("b")).select(value.alias("token")).distinct()
        drawn = df.sparkSession.createDataFrame([(x,) for x in random_strings(7)], "token string")
        labelled = secret.union(drawn).withColumn("secret", F.lit(True)).union(_ordinary(df, text_col, rows.count()).withColumn("secret", F.lit(False)))
    weights = train(labelled.select("token", "secret"))
    return rows.select(*key, "base", F.filter("__tokens", lambda x: ratio(x["text"], weights) > threshold).alias("random"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans (by start, base first) as text."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = {k: i for i, k in enumerate((*KINDS, "random"))}
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "random"), lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return found.select(key, *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("random").cast("long").alias("n_random"))

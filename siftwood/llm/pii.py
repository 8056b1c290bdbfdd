"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers.
They seed a bootstrap: every identifier-like token (a word with an @ or at least
four digits) is a mention of an instance (the token) in up to three patterns: the
word before it, the two words before it, the words on both sides. Another mention
among these words stands as #; a pattern has a word at least. Patterns and instances form a graph;
in each round a pattern's confidence is the share of its different instances that
are trusted, and an instance's score the noisy-or of its trusted patterns. Mentions
in trusted patterns that no base span covers are new spans of kind ``context``.
Everything runs as DataFrame functions; edges are aggregated before they are joined,
so the copies of one passage weigh as one edge.

Edge cases: null text counts as empty; empty texts have no span. Repeated rows and
ids stand for themselves. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm.common import checkpoint, renamed, text_or_empty
from siftwood.llm.spans import apart, joined, let, masked, matches, matches_between, overlapping, tagged

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: A local part starts behind another character or the match before; it is never
#: given up again, which keeps the search linear and finds the same matches.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _is_card(text: Column) -> Column:
    digits = _digits(text)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind of a text that is not null, in order."""
    found = {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP), lambda x: x["text"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(matches(text, CARD), lambda x: _is_card(x["text"])),
        "phone": F.filter(matches(text, PHONE, text.contains("+")), lambda x: F.length(_digits(x["text"])).between(9, 15)),
    }
    return {kind: tagged(kind, spans) for kind, spans in found.items()}


def _around(piece: Column) -> Column:
    """The first word and the last two words of the text between two mentions."""
    words = F.trim(F.regexp_replace(F.lower(piece), r"[^\p{L}\p{N}]+", " "))
    last = F.substring_index(words, " ", -1)
    before = F.substring_index(F.substring_index(words, " ", -2), " ", 1)
    several = words.contains(" ")
    return F.struct(F.substring_index(words, " ", 1).alias("first"), F.when(several, before).otherwise("").alias("before"), last.alias("last"))


def _mentions(text: Column) -> Column:
    """Identifier-like tokens, outer punctuation cut off, with their patterns."""
    found = matches_between(text, MENTION, _around, "struct<first:string,before:string,last:string>")

    def trim(x: Column, k: Column, between: Column) -> Column:
        lead = F.length(F.regexp_extract(x["text"], r"^[^\p{L}\p{N}+]*+", 0))
        core = F.regexp_replace(x["text"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
        left, right = between[k], between[k + 1]
        none = F.lit("")
        one = F.when(left["last"] != "", left["last"]).when(k > 0, "#").otherwise(none)
        other = F.when(left["before"] != "", left["before"]).when((left["last"] != "") & (k > 0), "#").when(F.get(between, k - 1)["last"] != "", F.get(between, k - 1)["last"]).when(k > 1, "#").otherwise(none)
        behind = F.when(right["first"] != "", right["first"]).when(k + 2 < F.size(between), "#").otherwise(none)
        patterns = F.array(F.when(one != "", F.concat(one, F.lit(" _"))), F.when((one != "") & (other != ""), F.concat(other, F.lit(" "), one, F.lit(" _"))), F.when((one != "") & (behind != ""), F.concat(one, F.lit(" _ "), behind)))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("token"), F.filter(patterns, lambda p: p.rlike(r"[\p{L}\p{N}]")).alias("patterns"))

    trimmed = let(found, lambda f: F.transform(f["spans"], lambda x, k: trim(x, k, f["between"])))
    return F.filter(trimmed, lambda x: x["token"].contains("@") | (F.length(_digits(x["token"])) >= 4))


def _bootstrap(mentions: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """Trusted patterns (pattern, confidence) from mentions (patterns, token, seed)."""
    edges = mentions.select(F.explode("patterns").alias("pattern"), "token", "seed").groupBy("pattern", "token").agg(F.max("seed").alias("seed"))
    # a pattern without any seed in reach of the rounds can't be trusted
    edges = checkpoint(edges)
    scores = edges.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("fixed"))
    trusted = None
    for _ in range(rounds):
        judged = edges.select("pattern", "token").join(scores, "token").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum((F.col("score") >= 0.5).cast("long")).alias("support"))
        trusted = checkpoint(judged.filter((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("pattern", "confidence"))
        doubt = edges.join(trusted, "pattern").groupBy("token").agg(F.sum(F.log(1 - 0.9 * F.col("confidence"))).alias("doubt"))
        scores = scores.join(doubt, "token", "left").select("token", F.when(F.col("fixed"), 1.0).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("score"), "fixed")
    return trusted


def find(df: DataFrame, key: list[str], text_col: str = "text", rounds: int = 3, confidence: float = 0.75, support: int = 3) -> DataFrame:
    """The key columns, base (tagged base spans by kind, then start) and context (the
    spans that the bootstrap adds, by start) of every row."""
    text = text_or_empty(F.col(text_col))
    rows = df.select(*[F.col(k) for k in key], text.alias("__text"))
    rows = rows.select(*key, *[spans.alias(f"__{kind}") for kind, spans in base_spans(F.col("__text")).items()], _mentions(F.col("__text")).alias("__mentions"))
    rows = rows.select(*key, F.concat(*[F.col(f"__{kind}") for kind in KINDS]).alias("base"), "__mentions", F.monotonically_increasing_id().alias("__row"))
    rows = rows.select(*key, "base", F.arrays_zip(F.col("__mentions").alias("m"), overlapping(F.col("__mentions"), F.col("base")).alias("seed")).alias("__mentions"), "__row")
    # the checkpoint fixes the row numbers and saves reading the texts again
    rows = checkpoint(rows)
    mentions = rows.filter(F.size("__mentions") > 0).select("__row", F.explode("__mentions").alias("x"))
    mentions = mentions.select("__row", "x.m.start", "x.m.end", "x.m.token", "x.m.patterns", "x.seed")
    trusted = _bootstrap(mentions, rounds, confidence, support)
    fresh = mentions.filter(~F.col("seed")).select("__row", "start", "end", "token", F.explode("patterns").alias("pattern"))
    fresh = fresh.join(trusted.select("pattern"), "pattern", "left_semi").select("__row", "start", "end", "token").distinct()
    span = F.struct(F.lit("context").alias("kind"), F.col("start"), F.col("end"), F.col("token").alias("text"))
    # the spans of one text: bounded by its length
    added = fresh.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", span.alias("span")))).alias("found"))
    out = rows.join(added.select("__row", F.transform("found", lambda x: x["span"]).alias("context")), "__row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
    return out.select(*key, "base", F.coalesce("context", none).alias("context"))


def mask(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``df`` with personal data replaced by <KIND> marks.

    Spans are joined back by key and the text's hash, so rows of one key with
    different texts keep their own.
    """
    plain, names = renamed(df)
    key, text_col = names[key], names[text_col]
    check = F.xxhash64(text_or_empty(F.col(text_col)))
    found = find(plain.select(F.col(key).alias("__key"), check.alias("__check"), text_col), ["__key", "__check"], text_col)
    found = found.filter((F.size("base") > 0) | (F.size("context") > 0)).dropDuplicates(["__key", "__check"])
    found = found.select("__key", "__check", F.concat("base", "context").alias("__spans"))
    rows = plain.withColumn("__own", check)
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__check"))
    out = rows.join(found.hint("shuffle_hash"), same, "left")
    text = F.when(F.col("__spans").isNotNull(), masked(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in plain.columns]).toDF(*df.columns)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "context")).alias("spans"), F.size("context").cast("long").alias("n_context"))


__all__ = ["KINDS", "apart", "base_spans", "digest", "find", "luhn", "mask"]

"""Text analysis as columns: tokens, units, trigrams, offsets, content sniffing."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwood.functions.patterns import ascii_lower, quote

WORD = r"[\p{IsAlphabetic}\p{N}_]+"
UNIT = r"[\p{IsAlphabetic}\p{N}]+"
#: Where a run splits into parts, besides underscores.
EDGE = r"(?<=\p{N})(?=[^\p{N}_])|(?<=[^\p{N}_])(?=\p{N})|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: A run that may be base64, with its padding.
BLOB = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: What a run with parts holds.
PARTED = r"[\p{N}_]|\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"
MAX_TOKEN_BYTES = 64


def runs(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def units(text: Column) -> Column:
    """In order, every run's parts (the whole run where it has none), as written."""
    return F.regexp_extract_all(F.regexp_replace(text, EDGE, " "), F.lit(UNIT), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body that uses a value several times; the value is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """The different tokens of a text in lower case: whole runs and their parts. Parts lie
    inside runs, so they are looked for once in each different run that can have any."""

    def with_parts(whole: Column) -> Column:
        parts = units(F.array_join(F.filter(whole, lambda r: r.rlike(PARTED)), " "))
        return F.array_distinct(F.transform(F.concat(whole, parts), F.lower))

    return let(F.array_distinct(runs(text)), with_parts)


def capped_tokens(text: Column) -> Column:
    """tokens(), each at most MAX_TOKEN_BYTES long; only texts with a longer one pay for it."""

    def cut(found: Column) -> Column:
        long = F.exists(found, lambda t: F.octet_length(t) > MAX_TOKEN_BYTES)
        return F.when(long, F.array_distinct(F.transform(found, capped))).otherwise(found)

    return let(tokens(text), cut)


def may_hold(text: Column, terms: list[str]) -> Column:
    """Whether a text can have one of some tokens: false only where it has none. Letters that
    lower() turns into ASCII ones fold here too; other terms aren't looked for."""
    if not all(t.isascii() for t in terms):
        return F.lit(True)
    return text.rlike("(?iu)" + "|".join(quote(t) for t in terms)) if terms else F.lit(False)


def capped(token: Column) -> Column:
    """At most 64 bytes of a token, cut between characters."""
    short = F.octet_length(token) <= MAX_TOKEN_BYTES
    sizes = F.filter(F.sequence(F.lit(1), F.lit(MAX_TOKEN_BYTES)), lambda k: F.octet_length(F.substr(token, F.lit(1), k)) <= MAX_TOKEN_BYTES)
    return F.when(short, token).otherwise(F.substr(token, F.lit(1), F.array_max(sizes)))


def exact_under_cap(token: str) -> bool:
    """Whether a capped token equal to this one can only be this one."""
    return len(token.encode()) < MAX_TOKEN_BYTES - 3


def normalize_token(token: str) -> str | None:
    ok = bool(token) and all(c.isalnum() or c == "_" for c in token)
    return token.lower() if ok else None


def normalized(text: Column) -> Column:
    """A text that is one token, in lower case; null for another one."""
    return F.when(text.rlike(rf"^{WORD}$"), F.lower(text))


def bytes_fields(content: Column, key: str) -> list[Column]:
    """A binary column for JSON: ``key`` with U+FFFD for what is no UTF-8, and
    ``key``_base64 with the exact bytes where that lost something."""
    text = content.cast("string")
    return [F.make_valid_utf8(text).alias(key), F.when(~F.is_valid_utf8(text), F.base64(content)).alias(f"{key}_base64")]


def bytes_item(content: Column) -> Column:
    """An array's item for JSON: the text, or an object with its base64."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)).otherwise(F.to_json(F.struct(F.base64(content).alias("base64"))))


def py_units(text: str) -> list[str]:
    """units() of a query argument, on the driver."""
    out = []
    for run in re.findall(r"\w+", text):
        part = ""
        for k, c in enumerate(run):
            before, after = (run[k - 1] if k else ""), run[k + 1 : k + 2]
            cut = before and (c == "_" or before == "_" or c.isnumeric() != before.isnumeric() or (before.islower() and c.isupper()) or (before.isupper() and c.isupper() and after.islower()))
            if cut and part:
                out.append(part)
                part = ""
            part += "" if c == "_" else c
        if part:
            out.append(part)
    return out


def text_match(text: Column, argument: str, exact: bool = False) -> Column:
    """Whether a document holds a term or phrase: its run as a whole token, or its units
    one behind the other. A cheap test for each unit comes before the tokenizer."""
    fold = (lambda c: c) if exact else F.lower
    words = [w if exact else w.lower() for w in py_units(argument)]
    if not words:
        return F.lit(False)
    line = F.concat(F.lit(" "), fold(F.regexp_replace(F.regexp_replace(text, EDGE, " "), rf"[^\p{{IsAlphabetic}}\p{{N}}]+", " ")), F.lit(" "))
    found = line.contains(" " + " ".join(words) + " ")
    if re.fullmatch(r"\w+", argument):
        # one run may also be a whole token: httprequest in HttpRequest
        whole = F.concat(F.lit(" "), fold(F.regexp_replace(text, rf"[^\p{{IsAlphabetic}}\p{{N}}_]+", " ")), F.lit(" "))
        found = found | whole.contains(f" {argument if exact else argument.lower()} ")
    for word in dict.fromkeys(words):
        found = fold(text).contains(word) & found
    return F.coalesce(found, F.lit(False))


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as a string of one character (U+0000 to U+00FF) each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def trigrams(text: Column) -> Column:
    """The different trigrams of a text's UTF-8 bytes (ASCII letters folded), one pass of a
    regex that looks three bytes ahead at every position."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(as_bytes(text)), F.lit("(?s)(?=(...))"), F.lit(1)))


def trigrams_among(text: Column, keys: list[str]) -> Column:
    """Those of some trigrams, all ASCII, that are in a text: trigrams() for these keys only."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?is)" + quote(k)), F.lit(k)) for k in keys]))


def trigram_keys(literal: str) -> list[str]:
    folded = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in literal.encode())
    return sorted({folded[i : i + 3] for i in range(len(folded) - 2)})


def byte_offset(text: Column, position: Column) -> Column:
    """0-based byte offset of a 1-based character position."""
    return F.octet_length(F.substr(text, F.lit(1), position - 1))


def is_binary(content: Column) -> Column:
    """A NUL in the first 8192 bytes of a binary column."""
    return F.position(F.lit(b"\x00"), F.substr(content, F.lit(1), F.lit(8192))) > 0


def strip_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)


def without_blobs(text: Column) -> Column:
    """The text with its base64-like runs blanked. Only the long runs of such characters go
    to Python; whether one goes is a matter of the run alone."""

    @F.pandas_udf("array<string>")
    def blank(found):
        import pandas as pd

        def one(run: str) -> str:
            for a, b in reversed(base64_spans(run)):
                run = run[:a] + " " + run[b:]
            return run

        return pd.Series([None if x is None else [one(r) for r in x] for x in found])

    blanked = blank(F.when(text.rlike(BLOB), F.regexp_extract_all(text, F.lit(BLOB), F.lit(0))))
    pieces = F.zip_with(F.split(text, BLOB, -1), blanked, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(blanked.isNotNull(), F.array_join(pieces, "")).otherwise(text)


def base64_spans(text: str) -> list[tuple[int, int]]:
    """Spans of base64-like runs of 20 or more characters that look random: not all hex,
    with digits, both cases, many case changes and few vowels in short lower-case runs."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(={0,2})", text):
        start, stop, pad = m.start(), m.end() - len(m[1]), len(m[1])
        while True:
            body = text[start:stop]
            head, tail = re.match(r"[^-_/]*[-_/]?", body)[0], re.search(r"[-_/]?[^-_/]*$", body)[0]
            if len(head) < len(body) and _written(head.rstrip("-_/")):
                start += len(head)
            elif len(tail) < len(body) and _written(tail.lstrip("-_/")):
                stop, pad = stop - len(tail), 0
            else:
                break
        body = text[start:stop]
        if len(body) >= 20 and not re.fullmatch("[0-9a-fA-F]+", body) and _random(body):
            out.append((start, stop + pad))
    return out


def _written(part: str) -> bool:
    return not part or (len(part) < 20 and part.islower() and part.isalpha()) or not _random(part)


def _random(body: str) -> bool:
    upper, lower, digits = sum(c.isupper() for c in body), sum(c.islower() for c in body), sum(c.isdigit() for c in body)
    if not digits or min(upper, lower) * 10 < len(body):
        return False
    pairs = [(a, b) for a, b in zip(body, body[1:], strict=False) if a.isalpha() and b.isalpha()]
    if sum(a.islower() != b.islower() for a, b in pairs) * 4 < len(pairs):
        return False
    low = re.findall("[a-z]+", body)
    if low and sum(map(len, low)) > 2.6 * len(low):
        return False
    longer = [x for x in low if len(x) > 1]
    return len(longer) < 2 or sum(bool(re.search("[aeiou]", x)) for x in longer) < 0.6 * len(longer)

"""Language identification with error-correcting output codes.

Every language owns a codeword of bits. For every bit there is one binary
n-gram classifier (log odds of hashed character 3- and 4-grams between the
languages whose bit is one and the others). A text's bit margins are compared
with all codewords under the logistic loss; the codeword of least loss wins, and
a text whose two best codewords are close is flagged as ambiguous.

Edge cases: null text, empty text or text without a letter gives ``und`` with
score 0. Rows whose language is null are not learnt from. Without any labelled
row every text is ``und``. Repeated rows are judged alike. Columns other than
the named ones are ignored.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm.words import blocks, text_bytes

BUCKETS = 1 << 15
SLICES = 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _b in range(128):
    if not (97 <= _FOLD[_b] <= 122):
        _FOLD[_b] = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed 3- and 4-grams, row of each) of the rows of one block."""
    low, high = int(offsets[0]), int(offsets[-1])
    n = len(offsets) - 1
    # every row gets a space before and after it
    size = np.diff(offsets)
    total = high - low + 2 * n
    flat = np.full(total, 32, dtype=np.uint8)
    row = np.repeat(np.arange(n), size + 2)
    at = np.arange(high - low) + 1 + 2 * np.repeat(np.arange(n), size)
    flat[at] = _FOLD[data[low:high]]
    keep = np.ones(total, dtype=bool)
    keep[1:] = ~((flat[1:] == 32) & (flat[:-1] == 32) & (row[1:] == row[:-1]))
    flat, row = flat[keep].astype(np.uint32), row[keep].astype(np.int32)
    out, rows = [], []
    code = flat[:-1] << 8 | flat[1:] if len(flat) else flat
    for k in (3, 4):
        m = len(flat) - k + 1
        if m <= 0:
            continue
        code = (code[:m] << 8) | flat[k - 1 :]
        same = row[:m] == row[k - 1 :]
        hashed = (code[same] * np.uint32(2654435761 if k == 3 else 2246822519)) >> np.uint32(32 - 15)
        out.append(hashed.astype(np.int32))
        rows.append(row[:m][same])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(rows)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords (rows of +1 and -1): exhaustive for up to 7 languages, else
    the best of several seeded random codes of 10 log2(n) bits."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.int8).T
    bits, rng, best, found = int(np.ceil(10 * np.log2(n))), random.Random(seed), -1, None
    for _ in range(50):
        code = np.array([[rng.choice((1, -1)) for _ in range(bits)] for _ in range(n)], dtype=np.int8)
        code = code[:, [len(set(code[:, j])) == 2 for j in range(bits)]]
        distance = code.shape[1] - code.astype(int) @ code.T.astype(int)
        least = distance[~np.eye(n, dtype=bool)].min() // 2
        if least > best:
            best, found = least, code
    return found


@dataclass
class Model:
    """languages, their codewords (languages x bits) and n-gram weights (buckets x bits)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    sharpness: float = 1.0


def _sum_counts(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Counts of hashed n-grams by language over all labelled rows (lang, text).

    Workers add up their own rows; slices of the sums are added up by key, so
    only languages x BUCKETS numbers reach the driver.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            codes = batch.column("lang").dictionary_encode()
            names, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets):
                hashed, row = _grams(data, offsets[i : j + 1])
                key = lang[i:j][row].astype(np.int64) * BUCKETS + hashed
                both = np.bincount(key, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + both[k]
        for name, total in sums.items():
            for s, part in enumerate(np.split(total.astype(np.int64), SLICES)):
                yield pa.RecordBatch.from_pydict({"lang": [name], "slice": pa.array([s], pa.int32()), "counts": [part.tobytes()]})

    def add(batches):
        key, total = None, None
        for batch in batches:
            for name, s, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "slice", "counts")), strict=True):
                part = np.frombuffer(raw, np.int64)
                if key == (name, s):
                    total = total + part
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_pydict({"lang": [key[0]], "slice": pa.array([key[1]], pa.int32()), "counts": [total.tobytes()]})
                key, total = (name, s), part
        if key is not None:
            yield pa.RecordBatch.from_pydict({"lang": [key[0]], "slice": pa.array([key[1]], pa.int32()), "counts": [total.tobytes()]})

    schema = "lang string, slice int, counts binary"
    parts = labelled.mapInArrow(count, schema).repartition("lang", "slice").sortWithinPartitions("lang", "slice").mapInArrow(add, schema)
    found: dict[str, list] = {}
    for name, s, raw in parts.collect():
        found.setdefault(name, [np.zeros(BUCKETS // SLICES, np.int64)] * SLICES)[s] = np.frombuffer(raw, np.int64)
    return {name: np.concatenate(slices) for name, slices in sorted(found.items())}


def train(df: DataFrame, text: str = "text", lang: str = "lang", prior: float = 0.5) -> Model:
    """Learn from all rows of ``df`` with a language; the caller selects the rows."""
    labelled = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = _sum_counts(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counts = {k: v for k, v in counts.items() if v.sum() > 0}
    languages = list(counts)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32))
    share = np.array([(c + prior) / (c.sum() + prior * BUCKETS) for c in counts.values()])
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        one = code[:, bit] > 0
        weights[:, bit] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
    return Model(languages, code, weights)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest codeword, its score, second best score) of each row of margins."""
    signed = model.sharpness * margins[:, None, :] * model.code[None, :, :]
    loss = np.logaddexp(0, -signed).sum(axis=2)
    weight = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share = weight / weight.sum(axis=1, keepdims=True)
    order = np.argsort(-share, axis=1, kind="stable")
    best = share[np.arange(len(share)), order[:, 0]]
    second = share[np.arange(len(share)), order[:, 1]] if share.shape[1] > 1 else np.zeros(len(share))
    return order[:, 0], best, second


def predict(df: DataFrame, model: Model, key: list[Column], text: str = "text", ambiguous_below: float = 0.55) -> DataFrame:
    """The ``key`` columns, lang_pred, score and ambiguous of every row of ``df``.

    Only the text decides. ``ambiguous`` marks scores under ``ambiguous_below``.
    """
    source = df.select(*key, F.col(text).cast("string").alias("__text"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    fields = source.schema.fields[: len(key)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, ambiguous boolean"])
    model = Model(model.languages, model.code, np.ascontiguousarray(model.weights), model.sharpness)

    def run(batches):
        names = [*model.languages, "und"]
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            n, bits = batch.num_rows, model.weights.shape[1]
            margins, grams = np.zeros((n, bits)), np.zeros(n)
            for i, j in blocks(offsets):
                hashed, row = _grams(data, offsets[i : j + 1])
                if len(hashed):
                    grams[i:j] = np.bincount(row, minlength=j - i)
                    for bit in range(bits):
                        margins[i:j, bit] = np.bincount(row, weights=model.weights[:, bit][hashed], minlength=j - i)
            known = batch.column("__letters").to_numpy(zero_copy_only=False) & bool(model.languages)
            pick, score, _ = decode(model, margins / np.maximum(grams, 1)[:, None]) if model.languages else (np.zeros(n, int), np.zeros(n), None)
            pick, score = np.where(known, pick, len(names) - 1), np.where(known, score, 0.0)
            out = [batch.column(f.name) for f in fields]
            out += [pa.array([names[k] for k in pick], pa.string()), pa.array(score, pa.float64()), pa.array(score < ambiguous_below)]
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in fields), "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, schema)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learnt from the rows not held out."""
    model = train(documents.filter(fold_of(F.col("doc_id")) != 1))
    return predict(documents, model, [F.col("doc_id"), (fold_of(F.col("doc_id")) == 1).alias("held_out")])

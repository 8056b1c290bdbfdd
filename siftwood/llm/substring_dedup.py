"""Removal of word passages that repeat from documents with smaller ids.

A window is ``min_words`` consecutive words. A word goes when a window that
covers it also starts in a document with a smaller id. The work is done with
suffix automata of reference shards and matching statistics:

1. Every window owns an anchor, the smallest hash among its runs of ANCHOR_WORDS
   words; equal windows own equal anchors. Neighbouring windows with one anchor
   form a segment. Segments (hashes only) are exchanged by anchor. A segment whose
   exact words occur under the same anchor in a smaller document is repeated as a
   whole, and an anchor of one document only needs no further look.
2. Of anchors with several different segments the first document's copy of each is
   a reference. These shards (the references of one anchor) become suffix automata;
   in ascending id each segment is streamed against what came before it, and
   matches of ``min_words`` words or more mark its windows.
3. An anchor with more than SHARD_SEGMENTS different segments would make a shard
   without bound; its windows are exchanged one by one by their own hash instead,
   which gives the same answer.

Copies are combined before the exchange: of equal segments in one batch of rows only
those of its smallest id travel, the others are known to repeat. Anchors that a sample
of the rows shows in very many different segments are treated as in 3 from the start.
The sample only chooses the route; the result is the same by either.

Shards are reached by content rather than by broadcasting each to every document:
sending all shards past all documents costs the square of the corpus.

Edge cases: null text counts as empty. A null id counts as 2^63 - 1, larger than all others;
rows with one id are one document (windows never repeat from their own id).
Texts of fewer words than a window keep all words. Passages are compared by 64-bit
hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm.automaton import SuffixAutomaton
from siftwood.llm.common import PARTS_PER_PARTITION, checkpoint, shuffle_partitions, text_or_empty
from siftwood.llm.words import blocks, hash_runs, hash_words, mix, text_bytes, word_spans

ANCHOR_WORDS = 5
SHARD_SEGMENTS = 4096
LAST_ID = 2**63 - 1
_SEGMENT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("check", "<i8"), ("at", "<u4"), ("windows", "<u2")])
_FOUND = np.dtype([("doc", "<i8"), ("check", "<i8"), ("at", "<u4"), ("windows", "<u2")])
_NEEDED = np.dtype([("doc", "<i8"), ("check", "<i8"), ("at", "<u4"), ("windows", "<u2"), ("split", "u1"), ("anchor", "<u8")])
_PACKED = "part int, kind int, payload binary"
SEGMENT, FOUND, NEEDED, CONTENT = range(4)
#: One row in SAMPLE_ROWS is looked at for hot anchors; those in more than HOT_SAMPLED
#: different segments of the sample are hot, and at most HOT_ANCHORS of them are kept.
SAMPLE_ROWS, HOT_SAMPLED, HOT_ANCHORS = 64, 32, 4096


def _pack(array: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(array[name]).tobytes() for name in array.dtype.names)


def _unpack(raw: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(raw) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for name in dtype.names:
        field = dtype[name]
        out[name] = np.frombuffer(raw, field, n, at)
        at += n * field.itemsize
    return out


def _by_part(kind: int, part: np.ndarray, array: np.ndarray):
    """One packed row for each part that has rows."""
    if not len(array):
        return
    order = np.argsort(part, kind="stable")
    part, array = part[order], array[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for i, j in zip(cut, [*cut[1:], len(part)], strict=True):
        yield int(part[i]), kind, _pack(array[i:j])


def _rows(items) -> pa.RecordBatch:
    part, kind, payload = zip(*items, strict=True) if items else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["part", "kind", "payload"])


def segments_of(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, row, first word, windows, window hashes, first window) of the
    segments of word hashes ``h`` whose row i holds words first[i]:first[i + 1]."""
    n = len(h) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z.astype(np.uint64), z
    runs = hash_runs(h, min(ANCHOR_WORDS, width))
    best, at = runs[:n].copy(), np.zeros(n, np.int64)
    for shift in range(1, width - min(ANCHOR_WORDS, width) + 1):
        other = runs[shift : shift + n]
        less = other < best
        best[less] = other[less]
        at[less] = shift
    at += np.arange(n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + width <= first[row + 1]
    begins = inside.copy()
    begins[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    start = np.flatnonzero(begins)
    upto = np.append(0, np.cumsum(inside))
    windows = upto[np.append(start[1:], n)] - upto[start]
    window = hash_runs(h, width)
    total = np.append(np.uint64(0), np.cumsum(window))
    content = mix(total[start + windows] - total[start] + windows.astype(np.uint64))
    return best[start], content, row[start], start - first[row[start]], windows, window, start


def _batch_segments(batch: pa.RecordBatch, width: int, hot: np.ndarray) -> np.ndarray:
    """The segments of one batch; those of hot anchors window by window."""
    data, offsets = text_bytes(batch.column("text"))
    ids, checks = batch.column("doc").to_numpy(), batch.column("check").to_numpy()
    found = [np.empty(0, _SEGMENT)]
    for i, j in blocks(offsets):
        starts, ends, first = word_spans(data, offsets[i : j + 1])
        anchor, content, row, at, windows, window, start = segments_of(hash_words(data, starts, ends), first, width)
        single = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), bool)
        part = np.empty(len(anchor), _SEGMENT)
        part["anchor"], part["content"], part["at"], part["windows"] = anchor, content, at, windows
        part["doc"], part["check"] = ids[i + row], checks[i + row]
        found.append(part[~single])
        if single.any():
            many, each = part[single], windows[single]
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            own = np.repeat(many, each)
            own["anchor"] = own["content"] = window[np.repeat(start[single], each) + step]
            own["at"] += step.astype(np.uint32)
            own["windows"] = 1
            found.append(own)
    return np.concatenate(found)


def _found(segments: np.ndarray) -> np.ndarray:
    out = np.empty(len(segments), _FOUND)
    for name in _FOUND.names:
        out[name] = segments[name]
    return out


def _emit_segments(width: int, parts: int, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            s = _batch_segments(batch, width, hot)
            key = s["content"] * np.uint64(0xC2B2AE3D27D4EB4F) + s["anchor"]
            order = np.lexsort((s["doc"], key))
            s, key = s[order], key[order]
            new = _change(key)
            again = s["doc"] > s["doc"][new][np.cumsum(new) - 1] if len(s) else new
            found, s = _found(s[again]), s[~again]
            yield _rows([*_by_part(FOUND, _bucket(found, parts), found), *_by_part(SEGMENT, (s["anchor"] % np.uint64(parts)).astype(np.int32), s)])

    return run


def _count_anchors(width: int):
    def run(batches):
        for batch in batches:
            s = np.unique(_batch_segments(batch, width, np.empty(0, np.uint64))[["anchor", "content"]])
            anchor, count = np.unique(s["anchor"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[count > 1].view(np.int64)), pa.array(count[count > 1], pa.int64())], names=["anchor", "n"])

    return run


def _groups(batches, *more):
    """(part, payloads by kind) of rows that arrive sorted by part."""
    now, held = None, {}
    for batch in batches:
        for part, kind, payload in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload"), strict=True):
            if part != now:
                if now is not None:
                    yield now, held
                now, held = part, {}
            held.setdefault(kind, []).append(payload.as_py())
    if now is not None:
        yield now, held


def _change(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def judge(s: np.ndarray, most: int = SHARD_SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(segments repeated as a whole, segments whose words are needed) of one part."""
    s = s[np.lexsort((s["at"], s["doc"], s["content"], s["anchor"]))]
    new_anchor, new_content = _change(s["anchor"]), _change(s["anchor"], s["content"])
    of_anchor, of_content = np.cumsum(new_anchor) - 1, np.cumsum(new_content) - 1
    least = s["doc"][new_content][of_content]
    whole = s["doc"] > least
    start = np.flatnonzero(new_anchor)
    several = (np.minimum.reduceat(s["doc"], start) != np.maximum.reduceat(s["doc"], start))[of_anchor] if len(s) else whole
    contents = np.bincount(of_anchor[new_content], minlength=len(start))
    needed = ~whole & several & (contents[of_anchor] > 1)
    found, need = _found(s[whole]), np.empty(needed.sum(), _NEEDED)
    for name in _FOUND.names:
        need[name] = s[name][needed]
    need["anchor"], need["split"] = s["anchor"][needed], contents[of_anchor][needed] > most
    return found, need


def _bucket(array: np.ndarray, parts: int) -> np.ndarray:
    return (mix(array["doc"].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _judge(parts: int):
    def run(batches):
        for part, held in _groups(batches):
            yield _rows([(part, FOUND, x) for x in held.get(FOUND, [])])
            if SEGMENT in held:
                found, need = judge(np.concatenate([_unpack(x, _SEGMENT) for x in held[SEGMENT]]))
                yield _rows([*_by_part(FOUND, _bucket(found, parts), found), *_by_part(NEEDED, _bucket(need, parts), need)])

    return run


def _merge(width: int):
    """Packed findings to one row for each document: covered word spans, needed segments."""

    def run(batches):
        for _, held in _groups(batches):
            found = np.concatenate([np.empty(0, _FOUND), *(_unpack(x, _FOUND) for x in held.get(FOUND, []))])
            need = np.concatenate([np.empty(0, _NEEDED), *(_unpack(x, _NEEDED) for x in held.get(NEEDED, []))])
            out: dict[tuple[int, int], list] = {}
            found = found[np.lexsort((found["at"], found["check"], found["doc"]))]
            cut = np.flatnonzero(_change(found["doc"], found["check"]))
            for i, j in zip(cut, [*cut[1:], len(found)], strict=True) if len(found) else ():
                low = found["at"][i:j].astype(np.int64)
                high = np.maximum.accumulate(low + found["windows"][i:j] + width - 1)
                first = np.append(True, low[1:] > high[:-1])
                last = np.append(first[1:], True)
                spans = np.column_stack([low[first], high[last]]).astype("<u4")
                out[int(found["doc"][i]), int(found["check"][i])] = [spans.tobytes(), None]
            need = need[np.lexsort((need["at"], need["check"], need["doc"]))]
            cut = np.flatnonzero(_change(need["doc"], need["check"]))
            for i, j in zip(cut, [*cut[1:], len(need)], strict=True) if len(need) else ():
                out.setdefault((int(need["doc"][i]), int(need["check"][i])), [None, None])[1] = _pack(need[i:j])
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([out[k][0] for k in keys], pa.binary()), pa.array([out[k][1] for k in keys], pa.binary())],
                names=["doc", "check", "spans", "need"],
            )

    return run


def _emit_content(width: int, parts: int):
    """The words of needed segments (as hashes), or one row for each of their windows."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            needs = [_unpack(x.as_py(), _NEEDED) for x in batch.column("need")]
            items, windows = [], []
            for i, j in blocks(offsets):
                starts, ends, first = word_spans(data, offsets[i : j + 1])
                h = hash_words(data, starts, ends)
                for row in range(i, j):
                    words = h[first[row - i] : first[row - i + 1]]
                    for x in needs[row]:
                        cut = words[x["at"] : x["at"] + x["windows"] + width - 1]
                        if x["split"]:
                            own = np.empty(x["windows"], _SEGMENT)
                            own["anchor"] = own["content"] = hash_runs(cut, width)
                            own["doc"], own["check"], own["windows"] = x["doc"], x["check"], 1
                            own["at"] = x["at"] + np.arange(x["windows"])
                            windows.append(own)
                        else:
                            head = np.array([x["anchor"], x["doc"].astype(np.uint64), x["check"].astype(np.uint64), x["at"], x["windows"]], dtype="<u8")
                            items.append((int(x["anchor"] % np.uint64(parts)), head.tobytes() + cut.tobytes()))
            packed: dict[int, list[bytes]] = {}
            for part, raw in items:
                packed.setdefault(part, []).append(raw)
            rows = [(part, CONTENT, b"".join(raw)) for part, raw in packed.items()]
            if windows:
                windows = np.concatenate(windows)
                rows += _by_part(SEGMENT, (windows["anchor"] % np.uint64(parts)).astype(np.int32), windows)
            yield _rows(rows)

    return run


def matched_windows(segments: list[tuple[int, int, np.ndarray]], width: int) -> list[np.ndarray]:
    """For segments (id, key, word hashes) of one shard in ascending id: the windows
    (first word) of each that occur in segments of smaller ids."""
    automaton, waiting, out, now = SuffixAutomaton(), [], [], None
    for doc, _, words in segments:
        if doc != now:
            for w in waiting:
                automaton.add(w)
            waiting, now = [], doc
        words = words.tolist()
        out.append(np.array([k - width + 1 for k, m in enumerate(automaton.matching(words)) if m >= width], dtype=np.int64))
        waiting.append(words)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _match(width: int, parts: int):
    def run(batches):
        for _, held in _groups(batches):
            segments = []
            for raw in held.get(CONTENT, []):
                flat, at = np.frombuffer(raw, "<u8"), 0
                while at < len(flat):
                    anchor, doc, check, pos, windows = (int(x) for x in flat[at : at + 5])
                    size = windows + width - 1
                    segments.append((anchor, _signed(doc), _signed(check), pos, flat[at + 5 : at + 5 + size]))
                    at += 5 + size
            segments.sort(key=lambda x: x[:4])
            found, i = [], 0
            while i < len(segments):
                j = i
                while j < len(segments) and segments[j][0] == segments[i][0]:
                    j += 1
                shard = segments[i:j]
                for (_, doc, check, pos, _), hit in zip(shard, matched_windows([(x[1], x[2], x[4]) for x in shard], width), strict=True):
                    if len(hit):
                        own = np.empty(len(hit), _FOUND)
                        own["doc"], own["check"], own["at"], own["windows"] = doc, check, pos + hit, 1
                        found.append(own)
                i = j
            if SEGMENT in held:
                found.append(judge(np.concatenate([_unpack(x, _SEGMENT) for x in held[SEGMENT]]))[0])
            if found:
                found = np.concatenate(found)
                yield _rows(list(_by_part(FOUND, _bucket(found, parts), found)))

    return run


def _finish(batches):
    for batch in batches:
        n = batch.num_rows
        texts = batch.column("text")
        size = np.array([0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64) if n else np.zeros(0, np.int64)
        for i, j in blocks(np.append(0, np.cumsum(size)), 8 << 20):
            words_n, removed_n, spans_out, kept_out = [], [], [], []
            for k in range(i, j):
                words = texts[k].as_buffer().to_pybytes().split()
                raw = [x.as_py() for x in (batch.column("spans1")[k], batch.column("spans2")[k])]
                spans = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in raw if x] or [np.empty((0, 2), "<u4")]).astype(np.int64)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                merged: list[list[int]] = []
                for low, high in spans.tolist():
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                kept, at = [], 0
                for low, high in merged:
                    kept += words[at:low]
                    at = high
                kept += words[at:]
                words_n.append(len(words))
                removed_n.append(len(words) - len(kept))
                spans_out.append([{"start": a, "end": b} for a, b in merged])
                kept_out.append(b" ".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept_out, pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"],
            )


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word spans, end exclusive) and kept (the
    kept words joined by one space) of every row of ``df``."""
    spark = df.sparkSession
    partitions = shuffle_partitions(spark)
    parts = partitions * PARTS_PER_PARTITION
    text = text_or_empty(F.col(text_col))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("check"), text.alias("text"))

    def exchanged(packed: DataFrame) -> DataFrame:
        return packed.repartition(partitions, "part").sortWithinPartitions("part")

    def merged(packed: DataFrame) -> DataFrame:
        return exchanged(packed).mapInArrow(_merge(min_words), "doc long, check long, spans binary, need binary")

    narrow = docs.select("doc", "check", "text")
    sampled = narrow.filter(F.pmod(F.xxhash64("doc", "check"), F.lit(SAMPLE_ROWS)) == 0).mapInArrow(_count_anchors(min_words), "anchor long, n long")
    hot = sampled.groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_SAMPLED).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS)
    hot = np.array([r.anchor for r in hot.collect()], np.int64).view(np.uint64)
    first = merged(exchanged(narrow.mapInArrow(_emit_segments(min_words, parts, hot), _PACKED)).mapInArrow(_judge(parts), _PACKED))
    first = checkpoint(first)
    # both joins below ask this exchange for all its columns, so it runs once
    docs = docs.repartition(partitions, "doc", "check")
    asked = docs.join(first.filter("need is not null").select("doc", "check", "need").hint("shuffle_hash"), ["doc", "check"])
    second = merged(exchanged(asked.select("doc_id", "doc", "check", "text", "need").mapInArrow(_emit_content(min_words, parts), _PACKED)).mapInArrow(_match(min_words, parts), _PACKED))
    one = first.filter("spans is not null").select("doc", "check", F.col("spans").alias("spans1"))
    two = second.select("doc", "check", F.col("spans").alias("spans2"))
    # rows of one id and check are one document: at most one row of findings each
    joined = docs.join(one.hint("shuffle_hash"), ["doc", "check"], "left").join(two.hint("shuffle_hash"), ["doc", "check"], "left")
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
    return joined.select("doc_id", "doc", "check", "text", "spans1", "spans2").mapInArrow(_finish, schema)

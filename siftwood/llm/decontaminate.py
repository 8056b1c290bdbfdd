"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: words in lower case, with numbers, units
behind numbers and names (capitalised inside a sentence) replaced by typed
placeholders. Windows of WINDOW template tokens are hashed, and the windows of the
documents are hash-joined with the benchmark's. The hits of a text and an item are then
walked alignment by alignment: a hit is accepted if its slots are consistent, that is if
on this alignment every slot value of the item stands for one value of the document, so
a question with other numbers or names is caught and a chance agreement of templates is
not. Evidence are the item's positions in an alignment's accepted windows that hold a word or a
slot with the item's own value. A text is contaminated by an item if accepted windows are

* ``coverage`` of the item's windows, with evidence of EVIDENCE positions, or
* WHOLE of them, with evidence of FEW positions (number-heavy and short questions), or
* a run of RUN tokens on one alignment, with evidence of EVIDENCE positions.

Nothing of the documents is collected. The driver holds a bit table of the benchmark's
windows (FILTER_BITS at most), which keeps other windows out of the exchange; the join
decides. Equal texts are judged once. A window that m items share costs m rows for each
different text that has it.

Edge cases: null text counts as empty and is clean, items with null text are left out;
item ids may be null and of any type. Items of fewer tokens than a window are one window,
items without a token match nothing. Repeated rows and items are judged alike. Text in
capitals throughout shows no names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm.common import checkpoint, shuffle_partitions, text_or_empty
from siftwood.llm.words import blocks, hash_runs, hash_words, mix, text_bytes

WINDOW = 8
EVIDENCE, WHOLE, FEW, RUN = 8, 0.8, 4, 50
FILTER_BITS = 1 << 27
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x11F0A1D3C5B79E21, 0x22E1B2C4D6A88F33, 0x33D2C3B5E7997045))
UNITS = "kg g mg lb lbs oz t km m cm mm mi ft in yd l ml gal h hr hrs hour hours min mins minute minutes s sec second seconds day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent pct mph kmh w kw v a hz khz mhz ghz kb mb gb tb c f k".split()

_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[128:] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63, 34]] = True


def _hash_texts(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return hash_words(data, np.append(0, ends[:-1] + 1), ends)


_UNIT_HASHES = np.sort(_hash_texts(UNITS))


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, value hashes, first): tokens first[i]:first[i + 1] are row i's."""
    low, high = int(offsets[0]), int(offsets[-1])
    part = data[low:high]
    if not len(part):
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(len(offsets), np.int64)
    lower = _LOWER[part]
    accent = np.zeros(len(part), bool)
    accent[1:] = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)
    lower[accent] += 32
    kind = _CLASS[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[offsets - low] = True
    change = kind[1:] != kind[:-1]
    begins = kind > 0
    begins[1:] &= change | edge[1:-1]
    stops = kind > 0
    stops[:-1] &= change | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if len(starts) > 1:
        # 3.5 and 1,000 are one number
        row = np.searchsorted(offsets - low, starts, side="right")
        joint = (kind[starts[1:]] == 1) & (kind[starts[:-1]] == 1) & (starts[1:] - ends[:-1] == 1) & (row[1:] == row[:-1])
        joint &= np.isin(part[np.minimum(ends[:-1], len(part) - 1)], (44, 46))
        starts, ends = starts[np.append(True, ~joint)], ends[np.append(~joint, True)]
    value = hash_words(lower, starts, ends)
    template = value.copy()
    number = kind[starts] == 1
    first = np.searchsorted(starts, offsets - low)
    opens = np.zeros(len(starts) + 1, bool)
    opens[first] = True
    opens = opens[: len(starts)]
    stop = np.append(0, np.cumsum(_STOP[part]))
    opens[1:] |= stop[starts[1:]] > stop[ends[:-1]]
    second = np.minimum(starts + 1, len(part) - 1)
    capital = _UPPER[part[starts]] & ~(_UPPER[part[second]] & (ends - starts > 1))
    capital |= (part[starts] == 0xC3) & accent[second]
    unit = np.isin(value, _UNIT_HASHES)
    unit[1:] &= number[:-1]
    unit[:1] = False
    template[capital & ~opens & ~number] = NAME
    template[unit & ~number] = UNIT
    template[number] = NUMBER
    return template, value, first


def _is_slot(template: np.ndarray) -> np.ndarray:
    return (template == NUMBER) | (template == UNIT) | (template == NAME)


def _lists(index: np.ndarray, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """For each window [begin, end) the values whose (sorted) index lies in it."""
    low, high = np.searchsorted(index, begin), np.searchsorted(index, end)
    size = high - low
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values[at]))


def _window_hashes(template: np.ndarray, length: int) -> np.ndarray:
    return mix(hash_runs(template, length) + np.uint64(length)).view(np.int64)


def _item_windows(batches):
    """item, n (its windows), tokens, length, at, h, slots (offsets in the window), own
    (the item's slot values) of every window of an item (item, text)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in blocks(offsets):
            template, value, first = templates(data, offsets[i : j + 1])
            for k in range(i, j):
                t, v = (x[first[k - i] : first[k - i + 1]] for x in (template, value))
                if not len(t):
                    continue
                length = min(WINDOW, len(t))
                n, slot = len(t) - length + 1, np.flatnonzero(_is_slot(t))
                at = np.arange(n)
                where = _lists(slot, slot.astype(np.int32), at, at + length)
                shifted = np.asarray(where.values) - np.repeat(at, np.diff(np.asarray(where.offsets))).astype(np.int32)
                same = lambda x, kind: pa.array(np.full(n, x), kind)  # noqa: B023, E731
                columns = [same(batch.column("item")[k].as_py(), pa.int64()), same(n, pa.int32()), same(len(t), pa.int32()), same(length, pa.int32()), pa.array(at, pa.int32()), pa.array(_window_hashes(t, length)), pa.ListArray.from_arrays(where.offsets, pa.array(shifted, pa.int32())), _lists(slot, v[slot].view(np.int64), at, at + length)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "tokens", "length", "at", "h", "slots", "own"])


def _bits(windows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit table of the windows' hashes and how many of their high bits address it."""
    address = 6
    while (1 << address) < min(FILTER_BITS, 256 * max(n, 1)):
        address += 1
    word = F.shiftrightunsigned("h", 64 - address)
    table = np.zeros(1 << (address - 6), np.uint64)
    # at most FILTER_BITS / 64 rows
    for r in windows.groupBy(F.shiftrightunsigned(word, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - address}) & 63 as int))")).alias("bits")).toLocalIterator():
        table[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return table, address


def _document_windows(sent, address: int, lengths: list[int]):
    def run(batches):
        """key, pos, h and values (of the slots) of the windows that the bit table has; a
        task takes a text once."""
        table, seen = sent.value, set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("key").to_pylist()
            for i, j in blocks(offsets):
                fresh = np.zeros(j - i, bool)
                for k in range(i, j):
                    fresh[k - i] = keys[k] not in seen
                    seen.add(keys[k])
                template, value, first = templates(data, offsets[i : j + 1])
                slot = np.flatnonzero(_is_slot(template))
                for length in lengths:
                    h = _window_hashes(template, length)
                    place = h.view(np.uint64) >> np.uint64(64 - address)
                    pos = np.flatnonzero((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(first, pos, side="right") - 1
                    own = (pos + length <= first[row + 1]) & fresh[np.minimum(row, j - i - 1)]
                    pos, row = pos[own], row[own]
                    columns = [pa.array([keys[i + r] for r in row.tolist()], pa.binary()), pa.array(pos - first[row], pa.int32()), pa.array(h[pos]), _lists(slot, value[slot].view(np.int64), pos, pos + length)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", "h", "values"])

    return run


class _Pair:
    """The hits of one text and one item, in the order of alignment and position."""

    def __init__(self, n: int, tokens: int, length: int) -> None:
        self.n, self.tokens, self.length = n, tokens, length
        self.accepted: set[int] = set()
        self.known = 0
        #: (accepted windows, slot values that differ) of the alignment with the most of them.
        self.best = (0, 0)
        self.longest = 0
        self.shift: int | None = None

    def add(self, shift: int, at: int, slots: list[int], own: list[int], values: list[int]) -> None:
        if shift != self.shift:
            self.shift, self.map, self.last, self.run, self.count = shift, {}, None, 0, 0
            self.evidence: set[int] = set()
        if at == self.last:
            return
        new = dict(zip(own, values, strict=True))
        if any(self.map.get(a, new[a]) != b or new[a] != b for a, b in zip(own, values, strict=True)):
            return
        self.map |= new
        self.run = self.run + 1 if self.last == at - 1 else 1
        self.last, self.longest = at, max(self.longest, self.run)
        self.accepted.add(at)
        other = {k for k, a, b in zip(slots, own, values, strict=True) if a != b}
        self.count += 1
        changed = sum(a != b for a, b in self.map.items())
        self.best = max(self.best, (self.count, changed), key=lambda x: (x[0], -x[1]))
        self.evidence.update(at + k for k in range(self.length) if k not in other)
        self.known = max(self.known, len(self.evidence))

    def verdict(self, least: float) -> tuple[bool, float, int]:
        share, known = len(self.accepted) / self.n, self.known
        run = self.longest + self.length - 1 >= RUN and self.longest > 0
        return (known >= EVIDENCE and (share >= least or run)) or (share >= WHOLE and known >= min(FEW, self.tokens)), share, self.best[1]


def _check(least: float):
    def run(batches):
        """Rows arrive sorted by key, item, shift and at; a pair may go on in the next batch."""
        now, pair = None, None
        for batch in batches:
            out = []
            for key, item, shift, at, n, tokens, length, slots, own, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, item) != now:
                    if pair is not None and pair.accepted:
                        out.append((*now, *pair.verdict(least)))
                    now, pair = (key, item), _Pair(n, tokens, length)
                pair.add(shift, at, slots, own, values)
            yield _verdicts(out)
        if pair is not None and pair.accepted:
            yield _verdicts([(*now, *pair.verdict(least))])

    return run


def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.float64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "item", "flag", "coverage", "n_slots"])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def verdicts(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, coverage: float) -> DataFrame:
    """key, contaminated, n_items, item_id, coverage, n_slots of the texts (key, text) that
    have an accepted window of an item."""
    text = F.col(item_text_col).cast("string")
    items = benchmark.filter(text.isNotNull()).select(F.xxhash64(F.col(item_col).cast("string"), text).alias("item"), F.col(item_col).alias("item_id"), text.alias("text")).dropDuplicates(["item"])
    windows = checkpoint(items.select("item", "text").mapInArrow(_item_windows, "item long, n int, tokens int, length int, at int, h long, slots array<int>, own array<long>"))
    sizes = windows.groupBy("length").count().collect()
    table, address = _bits(windows, sum(r["count"] for r in sizes))
    sent = texts.sparkSession.sparkContext.broadcast(table)
    found = texts.mapInArrow(_document_windows(sent, address, sorted(r["length"] for r in sizes)), "key binary, pos int, h long, values array<long>")
    hits = found.join(windows, "h").select("key", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", "n", "tokens", "length", "slots", "own", "values")
    hits = hits.repartition(shuffle_partitions(texts.sparkSession), "key", "item").sortWithinPartitions("key", "item", "shift", "at")
    pairs = hits.mapInArrow(_check(coverage), "key binary, item long, flag boolean, coverage double, n_slots long").join(items.select("item", "item_id"), "item")
    first = F.min(F.struct(~F.col("flag"), -F.col("coverage"), F.col("item_id"), F.col("n_slots").alias("n_slots"), F.col("coverage").alias("share"), F.col("flag").alias("flag"))).alias("x")
    return pairs.groupBy("key").agg(first, F.count("*").alias("n_items")).select("key", F.col("x.flag").alias("contaminated"), "n_items", "x.item_id", F.col("x.share").alias("coverage"), "x.n_slots")


def find(df: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.3) -> DataFrame:
    """The kept columns, contaminated, n_items (hit at all), item_id and coverage of the
    item covered best, and n_slots (its slot values that differ on the longest alignment)."""
    # names of the results must not clash with kept columns
    inner = [f"__k{k}" for k in range(len(keep))]
    text = text_or_empty(F.col(text_col))
    found = verdicts(df.select(text_key(text).alias("key"), text.alias("text")), benchmark, item_col, item_text_col, coverage)
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)], text_key(text).alias("key")).join(found, "key", "left")
    zero = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return rows.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], zero("contaminated", False), zero("n_items", 0), "item_id", zero("coverage", 0.0), zero("n_slots", 0))


def remove(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.3) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with their columns. Only the keys of
    contaminated texts are joined: the planner broadcasts them where they are few."""
    # under names of their own, columns of any name can't clash with the findings
    names = [f"__c{k}" for k in range(len(df.columns))]
    text = text_or_empty(F.col(names[df.columns.index(text_col)]))
    rows = df.toDF(*names).withColumn("__key", text_key(text))
    found = verdicts(rows.select(F.col("__key").alias("key"), text.alias("text")), benchmark, item_col, item_text_col, coverage)
    gone = checkpoint(found.filter("contaminated").select(F.col("key").alias("__key")))
    return rows.join(gone, "__key", "left_anti").select(*names).toDF(*df.columns)

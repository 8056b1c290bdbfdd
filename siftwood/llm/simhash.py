"""Near-duplicate classes by SimHash fingerprints and pivot distance tables.

Fingerprints of 64 bits are linked at ``radius`` or fewer differing bits; a class is
what links reach. Equal fingerprints are joined first. Different ones within the
radius agree on all bits of at least 2 of 6 blocks (radius 4), so rows are exchanged
by the 15 pairs of blocks; a bucket with more than HOT_BUCKET fingerprints is split
by the 70 choices of 4 of 8 blocks, on which near fingerprints agree as well. Any other
radius takes 2 of radius + 2 blocks and 4 of radius + 4. Inside
a bucket a pivot distance table holds every fingerprint's Hamming distances to
PIVOTS reference fingerprints. The bucket is sorted by the first distance and swept;
pairs whose largest coordinate difference exceeds the radius cannot be near (triangle
inequality) and are discarded, the survivors are verified. A bucket emits a spanning
forest of its links, never all pairs, and grows it while it is swept: pairs inside a tree
are not looked at again. No cap on partners is needed: every bucket is swept as a whole.

Edge cases: null or empty text has no word and the fingerprint zero, linked like any
other. Fewer words than a shingle count as one shingle. Rows with a null id get their
fingerprint and the component of rows with the same one (null if there is none), but
link nothing themselves. Repeated rows are rows of their own with one component.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm.common import checkpoint, shuffle_partitions
from siftwood.llm.components import connected_components
from siftwood.llm.words import blocks, text_bytes

PIVOTS = 16
HOT_BUCKET = 50_000
#: Radius 8 leaves 12 bits to a pair of blocks.
MOST_RADIUS = 8
_SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: bit set if set in over half of them."""
    flat = np.ascontiguousarray(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(flat), 1 << 14):
        ones += np.unpackbits(flat[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(flat), bitorder="little").view("<u8")[0])


def fingerprint_words(words: list[bytes], shingle: int = 4) -> int:
    """SimHash of lower-cased words: bit set if set in over half the shingle hashes."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, _SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.append(0, np.cumsum(sizes))
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        hashes = [digest(view[a:b], _SEED) for a, b in zip(start[:n].tolist(), (start[shingle:] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes() if len(data) < (1 << 22) else None
            out = np.zeros(batch.num_rows, dtype="<u8")
            for i, j in blocks(offsets):
                for k in range(i, j):
                    low, high = int(offsets[k]), int(offsets[k + 1])
                    text = raw[low:high] if raw is not None else data[low:high].tobytes()
                    out[k] = fingerprint_words(text.lower().split(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view("<i8"))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(parts: int, choose: int) -> list[int]:
    edge = np.linspace(0, 64, parts + 1).round().astype(int)
    block = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in itertools.pairwise(edge)]
    return [sum(block[i] for i in chosen) for chosen in itertools.combinations(range(parts), choose)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """One row for each mask: its number and the masked fingerprint."""
    options = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for k, mask in enumerate(masks)])
    return fps.select("fp", *keep, F.explode(options).alias("x")).select("fp", *keep, "x.m", "x.key")


def near_steps(fp: np.ndarray, group: np.ndarray, pivots: np.ndarray, radius: int, keep=None):
    """Positions (i, j) of different fingerprints of one group within the radius, those of
    one distance in the order at a time. Rows must be sorted by group, then by the distance
    to the first pivot. ``keep`` may tell rows (i) and pairs (i, j) to leave out."""
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int16)
    alive, step = np.arange(len(fp) - 1), 1
    while len(alive):
        alive = alive[alive + step < len(fp)]
        if keep is not None:
            alive = alive[keep(alive)]
        other = alive + step
        near = (group[alive] == group[other]) & (table[other, 0] - table[alive, 0] <= radius)
        alive, other = alive[near], other[near]
        i, j = alive, other
        if keep is not None:
            new = keep(i, j)
            i, j = i[new], j[new]
        for p in range(1, table.shape[1]):
            if not len(i):
                break
            close = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[close], j[close]
        close = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        yield i[close], j[close]
        step += 1


def near_pairs(fp: np.ndarray, group: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near_steps()."""
    steps = list(near_steps(fp, group, pivots, radius))
    return tuple(np.concatenate([x[k] for x in steps]) if steps else np.zeros(0, int) for k in (0, 1))


class Forest:
    """Trees over the rows of a bucket that grow while it is swept: pairs inside a tree and
    rows of groups that are one tree already are left out, so memory follows the rows."""

    def __init__(self, group: np.ndarray) -> None:
        self.group = group - (group[0] if len(group) else 0)
        self.label = np.arange(len(group))
        self.parent = np.arange(len(group))
        self.open = np.bincount(self.group) - 1 if len(group) else np.zeros(0, int)
        self.links: list[tuple[int, int]] = []

    def keep(self, i: np.ndarray, j: np.ndarray | None = None) -> np.ndarray:
        return self.open[self.group[i]] > 0 if j is None else self.label[i] != self.label[j]

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        before = len(self.links)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self._root(int(self.label[a])), self._root(int(self.label[b]))
            if x != y:
                self.parent[x] = y
                self.open[self.group[a]] -= 1
                self.links.append((a, b))
        if len(self.links) > before:
            while True:
                up = self.parent[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _sweep(pivots: np.ndarray, radius: int):
    def links(node, fp, m, key):
        group = np.cumsum(np.append(True, (m[1:] != m[:-1]) | (key[1:] != key[:-1])))
        order = np.lexsort((np.bitwise_count(fp ^ pivots[0]), group))
        node, fp, group = node[order], fp[order], group[order]
        forest = Forest(group)
        for i, j in near_steps(fp, group, pivots, radius, forest.keep):
            forest.add(i, j)
        ends = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]]), pa.array(node[ends[:, 1]])], names=["a", "b"])

    def run(batches):
        """Rows arrive sorted by (m, key); a group that may go on is carried over."""
        held = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp", "m", "key")]
            own[1] = own[1].view(np.uint64)
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            _, _, m, key = held
            if not len(m):
                continue
            last = np.flatnonzero((m != m[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: a spanning forest of the links between the nodes of ``fps`` (node, fp),
    whose fingerprints all differ."""
    if radius > MOST_RADIUS:
        raise ValueError(f"blocks are too small beyond a radius of {MOST_RADIUS}")
    partitions = shuffle_partitions(fps.sparkSession)
    reference = fps.select("fp").orderBy(F.xxhash64("fp")).limit(PIVOTS).collect()
    pivots = np.array([r.fp for r in reference] or [0], dtype=np.int64).view(np.uint64)
    keyed = _keyed(fps, _masks(radius + 2, 2), "node")
    hot = keyed.groupBy("m", "key").count().filter(F.col("count") > HOT_BUCKET).select("m", "key")
    hot = checkpoint(hot)
    usual = keyed.join(hot, ["m", "key"], "left_anti")
    split = keyed.join(hot, ["m", "key"]).select("node", "fp").distinct()
    finer = _keyed(split, _masks(radius + 4, 4), "node").withColumn("m", F.col("m") + 100)
    every = usual.select("node", "fp", "m", "key").union(finer.select("node", "fp", "m", "key"))
    return every.repartition(partitions, "m", "key").sortWithinPartitions("m", "key").mapInArrow(_sweep(pivots, radius), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``df``."""
    prints = checkpoint(fingerprints(df, id_col, text_col, shingle))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    classes = connected_components(near_links(distinct.filter("node is not null"), radius))
    named = distinct.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

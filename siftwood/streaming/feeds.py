"""Structured Streaming over change feeds: bursts, refreshes, stable ids, index following."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS, MOST_AGE_MS = 200, 1000
MOST_PENDING, MOST_BYTES = 100_000, 16 << 20
BURST = "root string, first_ms long, last_ms long, scopes array<string>, n long, backstop boolean, due_ms long"


def change_feed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def folded(events: Iterable[tuple[str | None, int, str]]) -> Iterator[tuple[str | None, int, int, list[str], int, bool]]:
    """Bursts (root, first, last, scopes, events, backstop) of events (root, ms, scope) that
    come root by root in time order. Only the open burst is held, and its scopes as long as
    they aren't too many."""
    root = first = last = None
    scopes, size, n, over = set(), 0, 0, False
    for at, ms, scope in events:
        if n and at == root and ms < min(last + QUIET_MS, first + MOST_AGE_MS):
            n += 1
        else:
            if n:
                yield root, first, last, sorted(scopes), n, over
            root, first, scopes, size, n, over = at, ms, set(), 0, 1, False
        last = ms
        if not over and scope not in scopes:
            scopes.add(scope)
            size += len(scope.encode())
            if len(scopes) > MOST_PENDING or size > MOST_BYTES:
                over, scopes = True, set()
    if n:
        yield root, first, last, sorted(scopes), n, over


def fold_bursts(events: list[tuple[int, str]]) -> list[tuple[int, int, list[str], int, bool]]:
    """Bursts (first, last, scopes, events, backstop) of one root's events (ms, scope) in
    time order: a burst is due 200 ms after its last or 1 s after its first event. Too
    many scopes or bytes escalate it to a full backstop."""
    return [burst[1:] for burst in folded((None, ms, scope) for ms, scope in events)]


#: Events of one root are looked at in stretches of so many milliseconds.
STRETCH_MS = 60_000


def sessions(events: DataFrame) -> DataFrame:
    """The events (root, ms, scope) with session: the first event's time of the run without
    a quiet gap that they are in. Gaps are found inside stretches of time; what a stretch
    leaves open is settled by one row for each stretch of a root."""
    from pyspark.sql import Window as W

    rows = events.withColumn("stretch", F.floor(F.col("ms") / STRETCH_MS))
    ends = rows.groupBy("root", "stretch").agg(F.max("ms").alias("last"))
    line = W.partitionBy("root").orderBy("stretch")
    ends = ends.withColumn("before", F.lag("last").over(line))
    rows = rows.join(ends.select("root", "stretch", "before"), ["root", "stretch"])
    inside = W.partitionBy("root", "stretch").orderBy("ms")
    gap = F.col("ms") - F.coalesce(F.lag("ms").over(inside), F.col("before"))
    rows = rows.withColumn("start", F.when(gap.isNull() | (gap >= QUIET_MS), F.col("ms")))
    rows = rows.withColumn("session", F.last("start", True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # a stretch that begins inside a session goes on with the last start before it
    starts = rows.groupBy("root", "stretch").agg(F.max("start").alias("latest"))
    carried = F.last("latest", True).over(line.rowsBetween(W.unboundedPreceding, -1))
    starts = starts.withColumn("carried", carried)
    rows = rows.join(starts.select("root", "stretch", "carried"), ["root", "stretch"])
    return rows.select("root", "ms", "scope", F.coalesce("session", "carried").alias("session"))


def bursts(events: DataFrame) -> DataFrame:
    """The same over a table (root, ms, scope). Gaps of the quiet time always part bursts, so
    sessions by gap come first, and only a session has to lie in one task. A task folds its
    sorted sessions one behind the other, however many they are."""
    rows = sessions(events).repartition("root", "session").sortWithinPartitions("root", "ms", "scope").select("root", "ms", "scope")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = folded(event for batch in batches for event in zip(*(batch.column(c).to_pylist() for c in ("root", "ms", "scope")), strict=True))
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.int64()]
        for some in itertools.batched(found, 2000):
            columns = zip(*((*burst, min(burst[2] + QUIET_MS, burst[1] + MOST_AGE_MS)) for burst in some), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in BURST.split(", ")])

    return rows.mapInArrow(fold, BURST)


def stream_bursts(events: DataFrame) -> DataFrame:
    """Bursts of a stream (root, ms, scope), with processing-time timers: state is the open
    burst of a root; what arrives later than its due time starts the next."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = list(zip(*state.get, strict=True)) if state.exists else []
        timed_out = state.hasTimedOut
        if not timed_out:
            for pdf in batches:
                pending += list(zip(pdf.ms.tolist(), pdf.scope.tolist(), strict=True))
        found = fold_bursts(sorted(pending))
        closed, rest = (found, []) if timed_out else (found[:-1], sorted(pending)[sum(b[3] for b in found[:-1]) :])
        if rest:
            state.update(([ms for ms, _ in rest], [s for _, s in rest]))
            state.setTimeoutDuration(QUIET_MS)
        elif state.exists:
            state.remove()
        rows = [(key[0], a, b, s, n, over, min(b + QUIET_MS, a + MOST_AGE_MS)) for a, b, s, n, over in closed]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BURST.split(", ")])

    return events.groupBy("root").applyInPandasWithState(update, BURST, "ms array<long>, scope array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def refresh(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run ``apply`` on every micro-batch of a feed. Batches are hints: applying one twice
    must observe again, not delete, so restarts do no harm."""
    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow_index(docs: DataFrame, folder: str, checkpoint: str):
    """Append the postings of new documents (doc_id, text) of a stream, batch by batch; a
    batch that is replayed leaves out what the coverage table already has."""
    from siftwood.operators import index

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            covered = spark.read.parquet(f"{folder}/coverage").select("doc_id")
            batch = batch.join(covered, "doc_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh = index.build(batch)
        for name in ("postings", "grams", "coverage"):
            getattr(fresh, name).write.mode("append").parquet(f"{folder}/{name}")

    return refresh(docs, apply, checkpoint)


def replay_log(log: DataFrame, folder: str, checkpoint: str, key: str = "id", seq: str = "seq"):
    """Keep the latest record of each key of a log stream as a table of versions."""
    from siftwood.operators.reconcile import latest, publish, published

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = published(spark, folder)
        if last is not None:
            batch = batch.unionByName(spark.read.parquet(f"{folder}/{last.version}"))
        # a batch that runs again after a crash writes beside what it left
        version = f"v{number}-{uuid.uuid4().hex}"
        latest(batch, key, seq).write.parquet(f"{folder}/{version}")
        publish(spark, folder, version)

    return refresh(log, apply, checkpoint)

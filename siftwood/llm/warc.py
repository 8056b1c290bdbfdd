"""WARC archives and their globally ordered capture index.

Writing tasks roll archives of gzip members and, beside each, a run: its captures
sorted by URL key and time, in compressed blocks with an index of first keys. Runs
merge with loser trees, FAN_IN at a time until few remain; those merge by ranges of
URL keys, every range in a task of its own that seeks to its part of each run. The
ordered rows carry each URL's capture number. Reading back goes archive by archive, each
in one pass, and puts the small rows of the records in order again. The pages have no
capture time: it is made of the page's id.

Files are written under names never used before into the shared folder, and only
those reported by a finished task are read, so lost and repeated tasks do no harm.

Edge cases: null html is the empty payload, a null url the empty target. A payload of
at least ``revisit_bytes`` is a response in the row of its smallest id and a revisit
elsewhere; rows that share that id and payload are all responses. A null id is never
the smallest. An empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm.common import checkpoint, shared_folder, shuffle_partitions

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
FAN_IN = 128
SAMPLE_KEYS = 10_000
EPOCH = 1_704_067_200
ROW = "urlkey string, ts long, page_id long, file string, offset long, length long, capture long"
RUN = "run string, low string, high string, sample array<string>"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, urlkey string, ts long, capture long"


def url_key(url: str) -> str:
    """Sortable form of a URL: host labels from the right, then path and query."""
    m = re.match(r"(?is)^[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)", url)
    if not m:
        return ")" + url.lower()
    host = m[1].rpartition("@")[2].lower().partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """K-way merge of sorted iterators: a replay from a leaf to the root needs one
    comparison a level, against the loser kept there."""

    def __init__(self, sources: Iterable[Iterator]) -> None:
        self.sources = list(sources)
        self.size = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [-1] * max(1, self.size)
        for leaf in range(self.size):
            self._replay(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, winner: int, filling: bool = False) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                if filling:
                    self.losers[node] = winner
                    return
            elif self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.size:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def write_run(uri: str, rows: Iterable[tuple]) -> tuple[str, str, list[str]] | None:
    """Write sorted (urlkey, ts, ...) rows; gives the first and last key and a sample."""
    system, path = _open(uri)
    index, low, high, at = [], None, None, 0
    with system.open_output_stream(path) as out:
        block: list[tuple] = []

        def flush() -> None:
            nonlocal at
            raw = zlib.compress(json.dumps(block).encode(), 1)
            index.append([block[0][0], at, len(raw)])
            out.write(raw)
            at += len(raw)
            block.clear()

        for row in rows:
            low = row[0] if low is None else low
            high = row[0]
            block.append(row)
            if len(block) == BLOCK_LINES:
                flush()
        if block:
            flush()
        foot = zlib.compress(json.dumps(index).encode())
        out.write(foot + len(foot).to_bytes(8, "big"))
    return (low, high, [x[0] for x in index[:: max(1, len(index) // 16)]]) if index else None


def read_run(uri: str, low: str | None = None, high: str | None = None) -> Iterator[tuple]:
    """The rows of a run with low <= urlkey < high, block by block."""
    system, path = _open(uri)
    with system.open_input_file(path) as source:
        end = source.size()
        source.seek(end - 8)
        size = int.from_bytes(source.read(8), "big")
        source.seek(end - 8 - size)
        index = json.loads(zlib.decompress(source.read(size)))
        keys = [x[0] for x in index]
        # rows of the key may begin in the block before the first one that starts with it
        first = 0 if low is None else max(0, bisect_right(keys, low) - 1)
        while first and low is not None and keys[first] >= low:
            first -= 1
        for key, at, length in index[first:]:
            if high is not None and key >= high:
                return
            source.seek(at)
            for row in json.loads(zlib.decompress(source.read(length))):
                if (low is None or row[0] >= low) and (high is None or row[0] < high):
                    yield tuple(row)


def _record_id(*parts) -> str:
    """The same for the same parts, so a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def _time(page_id: int | None) -> int:
    return EPOCH + (page_id or 0) % 31_536_000


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, ts: int) -> bytes:
    date = _date(ts)
    kind = "response" if refers_to is None else "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head + (payload if kind == "response" else b"")
    own = _record_id("response", page_id, digest) if kind == "response" else _record_id("revisit", page_id, digest, url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {url.translate(_LINE)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id('response', refers_to, digest)}", f"WARC-Refers-To-Date: {_date(_time(refers_to))}", f"Siftwood-Refers-To: {refers_to}"]
    lines += [f"Siftwood-Page: {'' if page_id is None else page_id}", f"Siftwood-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_LINE = {10: "%0A", 13: "%0D"}


def _date(ts: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(ts, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; the digest of a response is computed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    stated, size = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["Siftwood-Payload-Length"])
    if not revisit and (digest32(payload) != stated or len(payload) != size):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} doesn't match its digest")
    page = fields["Siftwood-Page"]
    return {"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": int(fields["Siftwood-Refers-To"]) if revisit else None, "url": fields["WARC-Target-URI"], "payload": None if revisit else payload}


def _write(folder: str):
    def run(batches):
        out, rows, at, name = None, [], 0, ""

        def close():
            nonlocal out
            out.close()
            out = None
            found = write_run(f"{name}.run", sorted(rows, key=lambda r: (r[0], r[1], r[4])))
            return pa.RecordBatch.from_pydict({"run": [f"{name}.run"], "low": [found[0]], "high": [found[1]], "sample": [found[2]]})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "first"))
                payload, ts = html.encode(), _time(page)
                if out is None:
                    name, rows, at = f"{folder}/{uuid.uuid4().hex}", [], 0
                    system, path = _open(f"{name}.warc.gz")
                    # gzip members are written here, record by record
                    out = system.open_output_stream(path, compression=None)
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = packer.compress(_record(page, url, payload, digest32(payload), first, ts)) + packer.flush()
                out.write(raw)
                rows.append((url_key(url), ts, page, f"{name}.warc.gz", at, len(raw)))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return run


def _merge_groups(folder: str):
    def run(batches):
        now, runs = None, []

        def merge():
            name = f"{folder}/{uuid.uuid4().hex}.run"
            found = write_run(name, LoserTree(read_run(r) for r in runs))
            return pa.RecordBatch.from_pydict({"run": [name], "low": [found[0]], "high": [found[1]], "sample": [found[2]]})

        for batch in batches:
            for group, name in zip(batch.column("group").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if group != now:
                    if runs:
                        yield merge()
                    now, runs = group, []
                runs.append(name)
        if runs:
            yield merge()

    return run


def _merge_ranges(cuts: list[str]):
    def batch_of(rows):
        names = ["urlkey", "ts", "page_id", "file", "offset", "length", "capture"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def ordered(part, runs):
        low, high = (cuts[part - 1] if part else None), (cuts[part] if part < len(cuts) else None)
        key, number, rows = None, 0, []
        for row in LoserTree(read_run(r, low, high) for r in runs):
            key, number = row[0], number + 1 if row[0] == key else 1
            rows.append((*row, number))
            if len(rows) == 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def run(batches):
        now, runs = None, []
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if part != now:
                    if runs:
                        yield from ordered(now, runs)
                    now, runs = part, []
                runs.append(name)
        if runs:
            yield from ordered(now, runs)

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Write one record for each row; gives the runs (one for each archive)."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    system, path = _open(folder)
    system.create_dir(path)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    hashed = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    first = hashed.filter(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # a written table: its real size is known when the join is planned
    first.select("digest", "first").write.parquet(f"{folder}/repeated")
    first = pages.sparkSession.read.parquet(f"{folder}/repeated")
    joined = rows.withColumn("digest", F.sha1("html")).join(first, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return checkpoint(joined.select("page_id", "url", "html", refers.alias("first")).mapInArrow(_write(folder), RUN))


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures ordered by URL key and time over the partitions, with capture (the
    number of the capture in its URL's history)."""
    spark = runs.sparkSession
    partitions = shuffle_partitions(spark)
    n = runs.count()
    while n > FAN_IN:
        folder = runs.select("run").first().run.rpartition("/")[0]
        groups = -(-n // (FAN_IN // 2))
        grouped = runs.select(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"), "run")
        runs = checkpoint(grouped.repartition(min(groups, partitions), "group").sortWithinPartitions("group").mapInArrow(_merge_groups(folder), RUN))
        n = runs.count()
    keys = runs.select(F.explode("sample").alias("key")).distinct().orderBy(F.xxhash64("key")).limit(SAMPLE_KEYS)
    keys = sorted(r.key for r in keys.collect())
    cuts = sorted({keys[len(keys) * k // partitions] for k in range(1, partitions)}) if keys else []
    edge = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    low, high = F.size(F.filter(edge, lambda c: c <= F.col("low"))), F.size(F.filter(edge, lambda c: c <= F.col("high")))
    # few runs are left, each in the ranges that it reaches
    parts = runs.select(F.explode(F.sequence(low, high)).alias("part"), "run")
    return parts.repartitionByRange(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", "run").mapInArrow(_merge_ranges(cuts), ROW)


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the rows of an index point to, as RECORD, in the index's order."""

    def run(batches):
        name = source = None
        for batch in batches:
            found = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name = file
                    system, path = _open(name)
                    source = system.open_input_file(path)
                source.seek(offset)
                found.append(parse_record(zlib.decompress(source.read(length), 31)))
            types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
            arrays = [pa.array([x[c] for x in found], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in ("urlkey", "ts", "capture"))], names=[*types, "urlkey", "ts", "capture"])
        if source is not None:
            source.close()

    partitions = shuffle_partitions(index.sparkSession)
    # an archive is read by one task from its start to its end; its size is bounded
    records = checkpoint(index.repartition(partitions, "file").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD))
    return records.repartitionByRange(partitions, "urlkey", "ts", "capture").sortWithinPartitions("urlkey", "ts", "capture")


def round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html), merge their index, read back."""
    return read_archives(merge_index(write_archives(pages, revisit_bytes=revisit_bytes)))

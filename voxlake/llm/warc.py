"""WARC archives with a two-level capture index.

Pages are range-partitioned and sorted by reversed-host url key. Each task writes one archive of gzip members, one for
each record, and the index of what it wrote: lines in key order, in compressed blocks, followed by a sparse directory of
the blocks' first keys. Equal payloads are stored once: the row with the smallest page_id is a response record, the others
are revisit records that name it. Readers hold one row for each archive; a look-up binary-searches these, then the
directory of one index file, and then reads one block and one record by range.

Files go to a folder that all executors share, through its own file system (pyarrow.fs), under names of their own for each
attempt; only the rows of successful tasks name files, and these rows are a written table.

Defined results: a null html is an empty payload; a null url has an empty key and no target header; a null page_id is last,
and a response unless a row of equal payload has an id; of rows that repeat the smallest id and a payload the one with the
least url is the response (of equal ones any), and the others revisit it under their own id; control characters in urls are percent-encoded in headers and kept in the index;
an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.scratch import materialise
from voxlake.llm.url_cascade import MAX_FILTER_BYTES, FilterTooLarge, bloom, held

BLOCK_LINES, BATCH = 256, 64
DATE = "1970-01-01T00:00:00Z"
#: Archives' first keys are held by every reader: one short row for each archive.
MAX_ARCHIVES = 1_000_000
#: Characters of a key that these rows hold.
KEY_CHARS = 128
#: False positives of the filter that spares rows of unrepeated payloads the join.
FILTER_RATE = 0.01
#: Records that one reading task takes, on average.
READ_RECORDS = 4096

_PARTS = "first string, last string, archive string, idx string, at long, size long, records long"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: `com,example,www)/a?b`; empty without `://`."""
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)
    return F.when(F.contains(url, F.lit("://")), key).otherwise("")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(name: str, url, payload: bytes | None, refers_to: str | None, sha: str) -> bytes:
    """One record with a name of its own; payload None: a revisit of the record that refers_to names."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    kind = "response" if payload is not None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"Content-Length: %d\r\n\r\n" % len(payload) + payload if payload is not None else b"\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] * bool(target)
    head += [f"WARC-Payload-Digest: sha1:{sha}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record's bytes (a gzip member)."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


#: Names that Spark's file systems have for schemes that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _response_name(page_id, sha: str) -> str:
    """The name of the one response with a payload."""
    return f"urn:page:{'' if page_id is None else page_id}:{sha}"


def _page_of(name: str) -> int | None:
    number = name.split(":")[2]
    return int(number) if number else None


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str):
    """rows(key, page_id, url, payload, refers_to, revisit, first) in key order -> one row for the task's archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = index = None
        at = records = place = 0
        lines: list[str] = []
        firsts: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal place
            if lines:
                packed = _member("\n".join(lines).encode())
                index.write(packed)
                firsts.append((json.loads(lines[0])["k"], place, len(packed)))
                place += len(packed)
                lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    system, root = _open(folder)
                    system.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
                    archive = system.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                    index = system.open_output_stream(f"{root}/{name}.index", compression=None)
                payload = row["payload"] or b""
                sha = digest(payload)
                if row["revisit"]:
                    packed = _member(_record(f"urn:revisit:{name}:{at}", row["url"], None, _response_name(row["refers_to"], sha), sha))
                else:
                    # payloads too small to be told apart can be stored several times under one id
                    own = _response_name(row["page_id"], sha)
                    packed = _member(_record(own if row["first"] else f"{own}:{name}:{at}", row["url"], payload, None, sha))
                archive.write(packed)
                lines.append(json.dumps({"k": row["key"], "id": row["page_id"], "url": row["url"], "o": at, "n": len(packed)}))
                at, records = at + len(packed), records + 1
                last = row["key"]
                if len(lines) == BLOCK_LINES:
                    flush()
        if archive is not None:
            flush()
            directory = _member(json.dumps(firsts).encode())
            index.write(directory)
            archive.close()
            index.close()
            row = {"first": firsts[0][0], "last": last, "archive": f"{name}.warc.gz", "idx": f"{name}.index", "at": place, "size": len(directory), "records": records}
            yield pa.RecordBatch.from_pylist([row])

    return run


@dataclass
class Store:
    folder: str
    archives: DataFrame  # one row for each archive


def _with_first(rows: DataFrame, repeats: DataFrame, max_bytes: int) -> DataFrame:
    """rows(_same, ...) with _first of repeats(_same, _first). Rows that a Bloom filter of repeats (up to max_bytes) rules out
    aren't moved; the others join exactly. Where the filter would be larger, all rows join."""
    number = repeats.count()
    null = F.lit(None).cast(repeats.schema["_first"].dataType).alias("_first")
    if not number:
        return rows.select("*", null)
    keys = [F.xxhash64("_same"), F.xxhash64(F.lit("second"), "_same")]
    try:
        level = bloom(repeats.select(keys[0].alias("h1"), keys[1].alias("h2")), number, FILTER_RATE, 1, max_bytes)
    except FilterTooLarge:
        return rows.join(repeats, "_same", "left")
    tested = rows.withColumn("_maybe", held(level)(*keys))
    maybe = tested.where("_maybe").drop("_maybe").join(repeats, "_same", "left")
    return tested.where("NOT _maybe").drop("_maybe").select("*", null).unionByName(maybe)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, max_filter_bytes: int = MAX_FILTER_BYTES) -> Store:
    """Archive every row of pages(page_id, url, html) in folder. Payloads of fewer than min_bytes are always stored."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"key": url_key(F.col("url")), "_same": F.sha2("payload", 256)})
    # of equal payloads the row with the smallest id comes first, of several with that id the least url
    place = F.struct(F.col("page_id").isNull().alias("late"), "page_id", F.col("url").isNull().alias("none"), "url")
    alike = rows.where(F.octet_length("payload") >= min_bytes).groupBy("_same", "page_id", "url").agg(F.count(F.lit(1)).alias("_n"))
    alike = alike.groupBy("_same").agg(F.min(F.struct(place.alias("at"), "_n")).alias("_least"), F.sum("_n").alias("_all"))
    repeats = alike.where("_all > 1").select("_same", F.struct("_least.at.page_id", "_least.at.url", F.col("_least._n").alias("n")).alias("_first"))
    rows = _with_first(rows, materialise(repeats, "warc-repeats"), max_filter_bytes)
    alone = F.col("_first").isNull()
    least = F.col("page_id").eqNullSafe(F.col("_first.page_id")) & F.col("url").eqNullSafe(F.col("_first.url"))
    kept = ["key", "page_id", "url", "payload", F.col("_first.page_id").alias("refers_to")]
    once = rows.where(alone | ~least | (F.col("_first.n") == 1)).select(*kept, (~alone & ~least).alias("revisit"), (F.octet_length("payload") >= min_bytes).alias("first"))
    # rows alike in everything are counted before they are moved; one of them is the response
    twins = rows.where(~alone & least & (F.col("_first.n") > 1)).groupBy("_same", "key", "page_id", "url").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("_n"))
    twins = twins.select("key", "page_id", "url", "payload", F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1), "_n")).alias("_k"))
    twins = twins.select("key", "page_id", "url", "payload", "refers_to", (F.col("_k") > 1).alias("revisit"), F.lit(True).alias("first"))
    # splitters hold the beginning of a key and the id: the order of keys decides within that
    short = F.substring("key", 1, KEY_CHARS)
    dealt = once.unionByName(twins).repartitionByRange(short, "page_id").sortWithinPartitions("key", "page_id")
    return Store(folder, materialise(dealt.mapInArrow(_write(folder), _PARTS), "warc-archives"))


class _Index:
    """Reads one index file: its directory, and blocks by range."""

    def __init__(self, system: fs.FileSystem, root: str, idx: str, at: int, size: int) -> None:
        self.file = system.open_input_file(f"{root}/{idx}")
        self.directory = json.loads(gzip.decompress(self.file.read_at(size, at)))
        self.firsts = [k for k, _, _ in self.directory]

        self.number, self.last = -1, []

    def block(self, number: int) -> list[dict]:
        """A block's lines; the last block read is held, as keys come in order."""
        if number != self.number:
            _, at, size = self.directory[number]
            self.number, self.last = number, [*map(json.loads, gzip.decompress(self.file.read_at(size, at)).decode().split("\n"))]
        return self.last

    def lines(self, key: str) -> Iterator[dict]:
        """The lines of a key: from the last block that starts before it on."""
        for number in range(max(0, bisect_left(self.firsts, key) - 1), len(self.firsts)):
            if self.firsts[number] > key:
                break
            lines = self.block(number)
            for k in range(bisect_left(lines, key, key=lambda x: x["k"]), len(lines)):
                if lines[k]["k"] != key:
                    break
                yield lines[k]


_CAPTURE = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"


def _capture(line: dict, data: bytes) -> dict:
    headers, payload = parse(data)
    refers = headers.get("WARC-Refers-To", "")[1:-1]
    kind = headers["WARC-Type"]
    sha = digest(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
    return {"page_id": line["id"], "url": line["url"], "record_type": kind, "payload_digest": sha, "refers_to": _page_of(refers) if refers else None, "payload": payload if kind == "response" else None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def read(store: Store) -> DataFrame:
    """Every record, by way of the index: a row for each block of each directory, then range reads of its records."""
    folder = store.folder

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = _Index(system, root, row["idx"], row["at"], row["size"])
                yield pa.RecordBatch.from_pylist([{"archive": row["archive"], "idx": row["idx"], "at": at, "size": size} for _, at, size in index.directory])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['idx']}") as index, system.open_input_file(f"{root}/{row['archive']}") as archive:
                    lines = [*map(json.loads, gzip.decompress(index.read_at(row["size"], row["at"])).decode().split("\n"))]
                    for k in range(0, len(lines), BATCH):
                        yield _batch([_capture(x, archive.read_at(x["n"], x["o"])) for x in lines[k : k + BATCH]])

    shape = "archive string, idx string, at long, size long"
    # short rows that stand for long reads: their bytes say nothing about the work, so the number of tasks is stated
    number = store.archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    found = store.archives.repartition("idx").mapInArrow(blocks, shape)
    return found.repartition(max(1, -(-number // READ_RECORDS)), "idx", "at").mapInArrow(records, _CAPTURE)


def look_up(store: Store, urls: DataFrame, nulls: bool = False) -> DataFrame:
    """The captures of urls(url), as `read` gives them; urls that aren't there give no row, and null gives those of pages
    without a url if `nulls` says so. Each url is dealt
    to the archives that can hold its key, so captures of one url in several archives are read by several tasks; there
    the keys come in order, and each is searched in the directory, then in a block."""
    number = store.archives.count()
    if number > MAX_ARCHIVES:
        raise ValueError(f"{number} archives; readers hold {MAX_ARCHIVES} at most: write with fewer, larger partitions")
    parts = sorted((r.first, r.last, r.archive, r.idx, r.at, r.size) for r in (row for row in store.archives.toLocalIterator()))
    shared = urls.sparkSession.sparkContext.broadcast(parts)
    folder = store.folder

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        # archives of keys with one beginning of KEY_CHARS overlap, so their last keys needn't ascend: running maxima do
        lasts = [*accumulate((p[1] for p in parts), max)]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            row, at = [], []
            for k, key in enumerate(keys):
                for n in range(bisect_left(lasts, key), len(parts)):
                    if parts[n][0] > key:
                        break
                    if parts[n][1] >= key:
                        row.append(k)
                        at.append(n)
            found = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *found.columns], ["part", "key", "url"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        parts, at, index, archive, rows = shared.value, -1, None, None, []
        for batch in batches:
            for number, key, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    at, index = number, _Index(system, root, *parts[number][3:])
                    archive = system.open_input_file(f"{root}/{parts[number][2]}")
                for line in index.lines(key):
                    if line["url"] == url:
                        rows.append(_capture(line, archive.read_at(line["n"], line["o"])))
                        if len(rows) == BATCH:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)

    asked = urls if nulls else urls.where(F.col("url").isNotNull())
    asked = asked.select(url_key(F.col("url")).alias("key"), "url").distinct().repartitionByRange("key")
    dealt = asked.mapInArrow(deal, "part int, key string, url string")
    return dealt.repartition(max(1, number), "part").sortWithinPartitions("part", "key").mapInArrow(search, _CAPTURE)


def summary(captures: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit has the length
    of the payload that it refers to."""
    slim = captures.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"))
    slim = materialise(slim, "warc-read")
    own = slim.where("record_type = 'response'")
    sizes = own.select("payload_digest", "payload_bytes").distinct()
    others = slim.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*columns).unionByName(others.select(*columns))


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Archive all pages, then find every capture again by its url through the index."""
    return summary(look_up(write(pages, folder), pages.select("url"), nulls=True))

"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A word is a match of the vocabulary's pattern. Documents are read in blocks of a bounded number of characters. A block keeps
the position of every word as a code, a place in the block's own list of distinct words. Those lists go through one shuffle by
word, in which each distinct word of the corpus is encoded once, by merging its bytes' least ranked neighbours; the ids
return to their blocks by a second, and position by position the documents are put together. What travels is each block's
distinct words and short codes, never the text, and a word that fills the corpus is one entry for each block. Decoding looks
ids up in the table of token bytes, whose size is the vocabulary's.

A block's name is a hash of its rows, its task and its number there, so every block is a group of its own. Should a lost task be
computed again from rows in another grouping (the input isn't a file scan), names don't meet and the job fails rather than
giving wrong ids; materialise such an input first.

Defined results: a null text is empty and has no ids; repeated rows are encoded each for itself; ids and keys may be null
or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.scratch import released

#: Characters of text in one block.
BLOCK_CHARS = 16_000_000
#: Documents whose codes travel in one row.
ROW_DOCS = 512


class Vocabulary(NamedTuple):
    ranks: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """The rank file and the pattern that splits texts; read on the driver and broadcast (one vocabulary's size)."""
        with open(path, "rb") as f:
            return cls(f.read(), pattern)


class _Loaded(NamedTuple):
    ranks: dict[bytes, int]
    split: Callable[[str], list[str]]


_loaded: dict[int, _Loaded] = {}


def _load(vocabulary: Vocabulary) -> _Loaded:
    """Once for each Python process."""
    key = hash(vocabulary)
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines())}
        _loaded[key] = _Loaded(ranks, regex.compile(vocabulary.pattern).findall)
    return _loaded[key]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: as long as two neighbouring parts are a token together, those with the least rank become one, the
    leftmost of equals first. A heap holds the pairs that were neighbours when they were seen."""
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    # the part that starts at a place: where it ends (0: none starts there any more), and where the part before it starts
    end, before = [*range(1, size + 1)], [*range(-1, size - 1)]
    pairs = [(ranks[word[k : k + 2]], k, k + 2) for k in range(size - 1) if word[k : k + 2] in ranks]
    heapify(pairs)
    while pairs:
        _, start, stop = heappop(pairs)
        middle = end[start]
        if not middle or middle == size or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < size:
            before[stop] = start
            if (rank := ranks.get(word[start : end[stop]])) is not None:
                heappush(pairs, (rank, start, end[stop]))
        if start and (rank := ranks.get(word[before[start] : stop])) is not None:
            heappush(pairs, (rank, before[start], stop))
    return [ranks[word[k : end[k]]] for k in range(size) if end[k]]


class _Block:
    """A block's rows: their words' places in the order in which words were first met, and the block's name."""

    def __init__(self, loaded: _Loaded, ordinal: int) -> None:
        self.split, self.chars = loaded.split, 0
        self.places: dict[str, int] = {}
        self.keys: list = []
        self.codes: list[np.ndarray] = []
        self.seen = xxhash.xxh3_64(np.array([TaskContext.get().partitionId(), ordinal]).tobytes())

    def add(self, key, text: str, coded: bool) -> None:
        words, places = self.split(text), self.places
        for word in words:
            if word not in places:
                places[word] = len(places)
        if coded:
            self.codes.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            self.keys.append(key)
        self.seen.update(f"{key}\0{len(text)}\0".encode())
        self.chars += len(text)

    def listed(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """The distinct words by bucket, then as they were met; their buckets; where each of them was met; the name."""
        encoded = [w.encode() for w in self.places]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.int64, len(encoded))
        order = np.argsort(bucket, kind="stable")
        self.seen.update(np.array([len(encoded), int(bucket.sum())]).tobytes())
        return [encoded[k] for k in order], bucket[order], order, self.seen.intdigest() - (1 << 63)

    def words(self, buckets: int) -> Iterator[pa.RecordBatch]:
        listed, bucket, _, name = self.listed(buckets)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
        ends = np.append(edges[1:], len(bucket))
        packed = [zstandard.ZstdCompressor(level=1).compress(b"\xff".join(listed[x:y])) for x, y in zip(edges, ends, strict=False)]
        if packed:
            columns = [pa.array([name] * len(packed), pa.int64()), pa.array(bucket[edges].astype(np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "words"])

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        _, _, order, name = self.listed(buckets)
        moved = np.empty(len(order), np.int32)
        moved[order] = np.arange(len(order))
        for at in range(0, len(self.keys), ROW_DOCS):
            keys, codes = self.keys[at : at + ROW_DOCS], self.codes[at : at + ROW_DOCS]
            sizes = np.fromiter(map(len, codes), np.int32, len(codes))
            row = {
                "block": pa.array([name], pa.int64()),
                "keys": pa.array([keys], pa.list_(pa.int64())),
                "sizes": pa.array([_pack(sizes)], pa.binary()),
                "codes": pa.array([_pack(moved[np.concatenate(codes)])], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(row)


def _pack(codes: np.ndarray) -> bytes:
    """Bytes of one weight stand together, which compresses best."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()) if len(codes) else b""


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


_WORD_ROWS = "block long, bucket int, words binary"
_CODE_ROWS = "block long, keys array<long>, sizes binary, codes binary"
_ID_ROWS = "block long, bucket int, sizes binary, ids binary"


def _blocks(shared: Broadcast, buckets: int, chars: int, coded: bool):
    """The rows of every block of a task's documents: its codes if coded, else its words. Blocks are cut alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _load(shared.value)
        block, ordinal, some = _Block(loaded, 0), 0, False
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(key, text.as_py() or "", coded)
                some = True
                if block.chars >= chars:
                    yield from block.rows(buckets) if coded else block.words(buckets)
                    ordinal += 1
                    block, some = _Block(loaded, ordinal), False
        if some:
            yield from block.rows(buckets) if coded else block.words(buckets)

    return run


def _encode_words(shared: Broadcast):
    """Rows in the order of buckets: a bucket's words are encoded when they are met first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _load(shared.value).ranks
        at, known = None, {}
        for batch in batches:
            for block, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                found = []
                for word in zstandard.ZstdDecompressor().decompress(packed).split(b"\xff"):
                    if word not in known:
                        known[word] = merged(word, ranks)
                    found.append(known[word])
                sizes = np.fromiter(map(len, found), np.int32, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "sizes": [_pack(sizes)], "ids": [_pack(ids)]})

    return run


def _assemble(codes: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block, from their codes and the ids of the block's words in the order of places."""
    words = sorted(zip(found.column("bucket").to_pylist(), found.column("sizes"), found.column("ids"), strict=True), key=lambda x: x[0])
    none = np.zeros(0, np.int32)
    sizes, ids = (np.concatenate([none, *(_unpack(w[k].as_py()) for w in words)]).astype(np.int64) for k in (1, 2))
    starts = np.cumsum(sizes) - sizes
    keys, lengths, out = [], [], []
    for row in range(codes.num_rows):
        places = _unpack(codes.column("codes")[row].as_py())
        if len(places) and places.max() >= len(sizes):
            raise RuntimeError("a block's words are missing: its rows were read in another grouping; materialise the input")
        keys.append(codes.column("keys")[row].values)
        n = sizes[places]
        ends = np.append(0, np.cumsum(n))
        out.append(ids[np.repeat(starts[places] - ends[:-1], n) + np.arange(ends[-1])].astype(np.int32))
        documents = np.append(0, np.cumsum(_unpack(codes.column("sizes")[row].as_py())))
        lengths.append(np.diff(ends[documents]))
    if not keys:
        raise RuntimeError("a block has words but no rows: its rows were read in another grouping; materialise the input")
    offsets = pa.array(np.append(0, np.cumsum(np.concatenate(lengths))).astype(np.int32))
    return pa.table({"doc_id": pa.concat_arrays(keys), "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))})


def encode(docs: DataFrame, vocabulary: Vocabulary, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids of every row of docs(doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    words = rows.mapInArrow(released(_blocks(shared, buckets, block_chars, False)), _WORD_ROWS)
    codes = rows.mapInArrow(released(_blocks(shared, buckets, block_chars, True)), _CODE_ROWS)
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_encode_words(shared)), _ID_ROWS)
    return codes.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded(doc_id, ids) with decoded: the bytes of the ids, from the broadcast table of token bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {rank: token for token, rank in _load(shared.value).ranks.items()}
        for batch in batches:
            found = [b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of decoded(doc_id, ids, decoded)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

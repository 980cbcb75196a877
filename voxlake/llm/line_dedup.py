"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words (runs without ASCII white space). Two lines match where the Jaccard similarity of
their sets is `SIMILARITY` or more, and a line that matches an earlier one goes: earlier in the order of ids, then of
lines. Lines with equal sets are one set, which counts from its first line on.

A set's words are ordered by rarity: by a frequency that is counted over all lines in a bounded table of hashed counters,
then by hash. Any one order gives the same result; this one makes beginnings rare. Sets that match share a word in their
first few: the shorter is indexed by the words of its short prefix, the longer asks with its longer one. Entries of one word
meet in one task (in blocks by bucket; those of very frequent words as rows), in the order of lengths, where filters of length, position and sketches (bits of a set's words, which
differ in no more places than two sets have different words) leave the candidates. No candidate leaves its task as a row: what
is written are edges that join them to clusters. A large group of lines, each unlike the next by a word, has as many
matches as pairs, but only as many edges as lines. The words of the sets of clusters are then read again from the texts, and
within a cluster (in cells of bounded size) the similarity of every two sets is computed in full; what is written are each set's
number of matches and the earliest of them. Words are compared by 64-bit hash, and sets are named by 128 bits.

Defined results: null and empty texts and lines of white space match nothing and stay; repeated rows (of one id and text)
are in the same place, so none is later than the other; ids may be null (last) or repeat (then hashes order the rows); an
empty table gives an empty result; other columns are ignored by `matches` and `classes` and returned by `deduplicate`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import counters
from voxlake.llm.components import components, roots
from voxlake.llm.scratch import discard, materialise, released
from voxlake.llm.shingles import mix, short_hashes

SIMILARITY = 0.8
#: Counters of words (8 bytes each on the driver, 4 in tasks).
COUNTERS = 1 << 23
#: Words in more lines than this have a class of lengths in their key.
FREQUENT = 1000
#: Bits of the filter that spares reading the words of lines in no candidate; what passes it is joined exactly.
FILTER_BITS = 1 << 26
#: Texts that one step holds at once.
STEP = 1024
BROADCAST_ROWS = 150_000
#: Entries that a task holds, pairs that it makes at once, and sets on a side of a cell.
BUFFER, SLAB, CELL = 1 << 18, 1 << 21, 1024
#: Words (of all texts) for each bucket of entries, and entries that are dealt to buckets at once.
BUCKET, BLOCK = 1 << 18, 1 << 19

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Lines:
    """The sets of all lines of a batch of texts: words in the order of rarity, line after line."""

    def __init__(self, texts: pa.Array, frequency: np.ndarray | None) -> None:
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        per_text = np.asarray(pc.list_value_length(lines)).astype(np.int64)
        flat = lines.flatten()
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(flat)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        lists = pc.ascii_split_whitespace(flat)
        words = lists.flatten()
        real = np.asarray(pc.binary_length(words)) > 0
        line = np.repeat(np.arange(len(flat)), np.asarray(pc.list_value_length(lists)).astype(np.int64))[real]
        coded = pa.array(short_hashes(words)[real]).dictionary_encode()
        table, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy(zero_copy_only=False)
        often = frequency[counters.places(table, COUNTERS)] if frequency is not None else np.zeros(len(table), np.int64)
        order = np.lexsort((table, often))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.sort(line << 32 | rank[codes])
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        self.line, at = pairs >> 32, order[pairs & 0xFFFFFFFF] if len(pairs) else np.zeros(0, np.int64)
        self.hashes, self.often = table[at], often[at]
        self.size = np.bincount(self.line, minlength=len(flat))
        self.start = np.cumsum(self.size) - self.size
        with np.errstate(over="ignore"):
            # names of sets: sums don't depend on the order of words
            ends = np.append(self.start, len(self.hashes))
            sums = [np.append(np.uint64(0), np.cumsum(mix(self.hashes ^ k))) for k in (_A, _B)]
            self.n1, self.n2 = (mix(s[ends[1:]] - s[ends[:-1]] + self.size.astype(np.uint64)) for s in sums)

    def sketches(self) -> list[np.ndarray]:
        """Four times 64 bits of each set: whether an odd number of its words fall on a bit. Two sets' bits, and those of the
        four parts laid over each other, differ in no more places than the sets have different words."""
        some = np.flatnonzero(self.size)
        bit = np.left_shift(np.uint64(1), self.hashes & np.uint64(63))
        part = self.hashes >> np.uint64(6) & np.uint64(3)
        out = []
        for k in range(4):
            bits = np.zeros(len(self.size), np.uint64)
            if len(some):
                bits[some] = np.bitwise_xor.reduceat(np.where(part == np.uint64(k), bit, np.uint64(0)), self.start[some])
            out.append(bits)
        return out


def _word_list(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a batch of texts, and how often each occurs."""
    words = np.sort(short_hashes(pc.ascii_split_whitespace(pc.fill_null(batch.column(0), "")).flatten()))
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
    return words[first], np.diff(np.append(first, len(words)))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def least_overlap(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """Words that sets of n and m words must share: the least s with s / (n + m - s) >= t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def _class(n: np.ndarray, t: float) -> np.ndarray:
    """Classes of lengths: a partner is in a set's own class or the one below."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(t) + 1e-9).astype(np.int64)


_SKETCH = ["k0", "k1", "k2", "k3"]
_LINES = "doc_id long, m1 long, m2 long, line int, n1 long, n2 long, size int, k0 long, k1 long, k2 long, k3 long, entries binary, hot array<struct<word:long,place:int>>"
_ENTRY = np.dtype([("word", "<i8"), ("place", "<i4")])


def _entries(x: Lines, once: np.ndarray, t: float, buffer: int) -> tuple[pa.Array, pa.Array]:
    """For each line its prefix words' keys and places, by rarity: four times the position, plus 1 where the word is in the
    shorter prefix that others ask for, plus 2 where the line asks with it. A frequent word's key holds a class of lengths, and a
    line asks in its own class and the one below. Words that no other line can hold are left out; null where not `once`. First
    those of words that occur at most `buffer` times, as bytes, then the others."""
    n = x.size
    own = n - least_overlap(n, n, t) + 1
    # a set meets only its own kind where any partner's overlap would be the whole of both
    smallest = np.ceil(t * n - 1e-9).astype(np.int64)
    asks = np.where(smallest < n, n - np.maximum(smallest, 1) + 1, np.where(own > 1, own, 0))
    given = np.where((np.floor(n / t + 1e-9) > n) | (own > 1), own, 0)
    at = np.arange(len(x.line)) - x.start[x.line]
    keep = once[x.line] & (at < np.maximum(asks, given)[x.line]) & (x.often > 1)
    word, line, at, often = x.hashes[keep], x.line[keep], at[keep], x.often[keep]
    many = often > FREQUENT
    kind = _class(n, t)[line]
    flags = (at < given[line]) + 2 * (at < asks[line])
    with np.errstate(over="ignore"):
        key = lambda c: mix(word + np.where(many, c + 1, 0).astype(np.uint64) * _A)
        below = many & (at < asks[line])
        words = np.concatenate([key(kind), key(kind - 1)[below]])
    places = np.concatenate([at * 4 + flags, at[below] * 4 + 2])
    lines = np.concatenate([line, line[below]])
    hot = np.concatenate([often, often[below]]) > buffer
    order = np.argsort(lines, kind="stable")

    def split(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _signed(words[some]), places[some].astype(np.int32), np.append(0, np.cumsum(np.bincount(lines[some], minlength=len(n)))).astype(np.int32)

    word, place, ends = split(order[~hot[order]])
    data = np.empty(len(word), _ENTRY)
    data["word"], data["place"] = word, place
    there = pa.array(once).buffers()[1]
    few = pa.Array.from_buffers(pa.binary(), len(n), [there, pa.py_buffer(ends * np.int32(_ENTRY.itemsize)), pa.py_buffer(data)])
    word, place, ends = split(order[hot[order]])
    none = np.append(np.diff(ends) == 0, False)
    return few, pa.ListArray.from_arrays(pa.array(ends, mask=none), pa.StructArray.from_arrays([pa.array(word), pa.array(place)], ["word", "place"]))


def _line_rows(shared: Broadcast, t: float, buffer: int):
    """rows(doc_id, m1, m2, text) -> a row for each line with words; of equal sets the first of a step holds the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in _steps(batches):
            x = Lines(batch.column(3), frequency)
            some = np.flatnonzero(x.size)
            once = np.zeros(len(x.size), bool)
            once[np.unique(x.n1, return_index=True)[1]] = True
            row, keep = pa.array(x.text[some]), pa.array(some)
            columns = [*(batch.column(k).take(row) for k in range(3)), pa.array(x.number[some].astype(np.int32)), pa.array(_signed(x.n1[some])), pa.array(_signed(x.n2[some]))]
            columns += [pa.array(x.size[some].astype(np.int32)), *(pa.array(_signed(k[some])) for k in x.sketches()), *(e.take(keep) for e in _entries(x, once, t, buffer))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "m1", "m2", "line", "n1", "n2", "size", *_SKETCH, "entries", "hot"])

    return run


def _likely(a: np.ndarray, b: np.ndarray, size: np.ndarray, place: np.ndarray, sketches: np.ndarray, name: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of entries of one word in which enough words can follow the shared one, and the sketches don't differ
    too much."""
    keep = (size[b] < size[a]) | (name[a] > name[b])
    a, b = a[keep], b[keep]
    need = least_overlap(size[a], size[b], t)
    i, j = place[a] >> 2, place[b] >> 2
    keep = 1 + np.minimum(size[a] - i, size[b] - j) - 1 + np.minimum(i, j) >= need
    a, b, room = a[keep], b[keep], (size[a] + size[b] - 2 * need)[keep]
    apart = np.zeros(len(a), np.int64)
    for k in range(sketches.shape[1]):
        apart += np.bitwise_count(sketches[a, k] ^ sketches[b, k])
        keep = apart <= room
        a, b, room, apart = a[keep], b[keep], room[keep], apart[keep]
    return a, b


def _spread(asks: np.ndarray, lo: np.ndarray, count: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each asking entry beside its `count` given ones from `lo` on."""
    return np.repeat(asks, count), given[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]


def _slabs(count: np.ndarray) -> Iterator[slice]:
    """Entries whose pairs a task makes at once."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right")))
        yield slice(at, end)
        at = end


def _found(t: float, joined: bool):
    """Entries (word, size, place, name, sketches ...) in the order of (word, size) -> the names of sets that can match another
    or, if joined, edges that join all those that can match. Of a step's pairs only a slab exists at once: what a slab tells goes
    into one number for each set (its component or, if not joined, -1 once it can match some other)."""

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word, size, place, name = columns[0], columns[1].astype(np.int64), columns[2].astype(np.int64), columns[3]
        sketches = np.stack([c.view(np.uint64) for c in columns[4:]], 1)
        likely = lambda a, b: _likely(a, b, size, place, sketches, name, t)
        group = np.cumsum(np.append(False, word[1:] != word[:-1])[: len(word)]).astype(np.int64)
        given, asks = np.flatnonzero(place & 1), np.flatnonzero(place & 2)
        least = np.ceil(size * t - 1e-9).astype(np.int64)
        sizes = (group[given] << 32) + size[given]
        lo = np.searchsorted(sizes, (group[asks] << 32) + least[asks])
        count = np.searchsorted(sizes, (group[asks] << 32) + size[asks], side="right") - lo
        if count.sum() <= SLAB:
            a, b = likely(*_spread(asks, lo, count, given))
            if not len(a):
                return
            names, at = np.unique(np.concatenate([name[a], name[b]]), return_inverse=True)
            state = roots(len(names), at[: len(a)], at[len(a) :]) if joined else np.full(len(names), -1)
        else:
            names, at = np.unique(name, return_inverse=True)
            state = np.arange(len(names))

            def learn(a: np.ndarray, b: np.ndarray) -> None:
                nonlocal state
                if joined:
                    state = roots(len(names), at[a], at[b], state)
                else:
                    state[at[a]] = state[at[b]] = -1

            total = np.bincount(group[asks], count, minlength=group[-1] + 1)
            few = total[group[asks]] <= SLAB
            for some in _slabs(count[few]):
                learn(*likely(*_spread(asks[few][some], lo[few][some], count[few][some], given)))
            for g in np.flatnonzero(total > SLAB):
                # the longest first, which meet all others; two of one state tell nothing new, and most soon have the same one
                own, rest = given[group[given] == g], asks[group[asks] == g][::-1]
                while len(rest):
                    common = int(np.bincount(state[at[own]]).argmax()) if joined else -1
                    others, same = own[state[at[own]] != common], state[at[rest]] == common
                    low, number = np.zeros((2, len(rest)), np.int64)
                    for kind, partners in ((same, others), (~same, own)):
                        low[kind] = np.searchsorted(size[partners], least[rest[kind]])
                        number[kind] = np.searchsorted(size[partners], size[rest[kind]], side="right") - low[kind]
                    some = next(_slabs(number))
                    for kind, partners in ((same[some], others), (~same[some], own)):
                        learn(*likely(*_spread(rest[some][kind], low[some][kind], number[some][kind], partners)))
                    rest = rest[some.stop :]
        if not joined:
            yield pa.RecordBatch.from_arrays([pa.array(names[state == -1])], ["name"])
            return
        far = np.flatnonzero(state != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[state[far]])], ["a", "b"])

    return found


def _meet(t: float, joined: bool):
    """Entries of words with more than a bucket may hold, sorted as rows. Of a word that fills a whole buffer only the sets stay
    that are long enough for longer ones to come (`_cut` bounds how many entries have one word)."""
    found = _found(t, joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        fresh = 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            # copies of a set, from several steps, stand side by side
            new = np.append(True, np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0))
            columns = [c[new] for c in columns]
            word = columns[0]
            start = int(np.searchsorted(word, word[-1]))
            done = len(word) if last or start == 0 else start
            yield from found([c[:done] for c in columns])
            kept = np.arange(done, len(word))
            if done == len(word) and not last:
                # these have met each other, and no later one is shorter: they only wait to be asked for
                kept = np.flatnonzero((columns[1] >= math.ceil(t * columns[1][-1] - 1e-9)) & (columns[2] & 1 > 0))
                columns[2] = columns[2] & ~2
            held = [[c[kept] for c in columns]] if len(kept) else []

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            fresh += batch.num_rows
            if fresh >= BUFFER:
                yield from close(False)
                fresh = 0
        yield from close(True)

    return run


def _record(sketches: int) -> np.dtype:
    return np.dtype([("word", "<i8"), ("name", "<i8"), ("sketch", "<i8", (sketches,)), ("size", "<i4"), ("place", "<i4")])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and each value's number of bytes."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]], np.diff(ends)


def _blocks(buckets: int, sketches: int):
    """rows(size, name, entries, sketches ...) -> blocks of entries by the bucket of their word."""
    record = _record(sketches)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (rows["word"].view(np.uint64) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = (np.append(first, len(rows)) * record.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(rows[order])])
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), data], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        number = 0
        for batch in batches:
            data, lengths = _bytes_of(batch.column(2))
            entries, own = data.view(_ENTRY), np.repeat(np.arange(batch.num_rows), lengths // _ENTRY.itemsize)
            rows = np.empty(len(entries), record)
            rows["word"], rows["place"] = entries["word"], entries["place"]
            rows["size"], rows["name"] = batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own]
            for k in range(sketches):
                rows["sketch"][:, k] = batch.column(3 + k).to_numpy()[own]
            if len(rows):
                held.append(rows)
                number += len(rows)
            if number >= BLOCK:
                yield dealt(held)
                held, number = [], 0
        if held:
            yield dealt(held)

    return run


def _meet_blocks(t: float, joined: bool, sketches: int):
    """Blocks(bucket, data) in the order of buckets: a bucket's entries are sorted, and meet, in one step."""
    found, record = _found(t, joined), _record(sketches)

    def closed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held).view(record)
        # words of one entry have no pairs
        order = np.argsort(rows["word"])
        word = rows["word"][order]
        same = word[1:] == word[:-1]
        rows = rows[order[np.append(False, same) | np.append(same, False)]]
        rows = rows[np.lexsort((rows["name"], rows["size"], rows["word"]))]
        keys = [rows[c] for c in ("word", "size", "place", "name")]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in keys], axis=0))[: len(rows)]
        rows = rows[new]
        yield from found([*(np.ascontiguousarray(rows[c]) for c in ("word", "size", "place", "name")), *(np.ascontiguousarray(rows["sketch"][:, k]) for k in range(sketches))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bucket = None
        for batch in batches:
            data, lengths = _bytes_of(batch.column(1))
            ends = np.append(0, np.cumsum(lengths))
            for k, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket and held:
                    yield from closed(held)
                    held = []
                bucket = b
                held.append(data[ends[k] : ends[k + 1]].copy())
        if held:
            yield from closed(held)

    return run


def _met(rows: DataFrame, sketches: list[F.Column], buckets: int, large: DataFrame | None, t: float, joined: bool) -> DataFrame:
    """What the entries of rows find where they meet. Those of very frequent words, which no task may hold together, are rows that
    Spark sorts; all others travel in blocks."""
    schema = "a long, b long" if joined else "name long"
    kept = [x.alias(f"s{k}") for k, x in enumerate(sketches)]
    blocks = rows.select("size", F.col("n1").alias("name"), "entries", *kept).mapInArrow(released(_blocks(buckets, len(kept))), "bucket int, data binary")
    found = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_meet_blocks(t, joined, len(kept))), schema)
    hot = rows.where("hot IS NOT NULL").select(F.explode("hot").alias("e"), "size", F.col("n1").alias("name"), *kept)
    hot = _cut(hot.select("e.word", "size", "e.place", "name", *[f"s{k}" for k in range(len(kept))]), large)
    return found.unionByName(hot.repartition("word").sortWithinPartitions("word", "size", "name").mapInArrow(released(_meet(t, joined)), schema))


def _large(rows: DataFrame) -> DataFrame | None:
    """word and n of the words of more than BUFFER entries that are rows: one for each BUFFER of such entries, at most."""
    words = rows.where("hot IS NOT NULL").select(F.explode("hot.word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = materialise(words.where(F.col("n") > BUFFER), "line-large-words")
    return None if found.isEmpty() else found


def _cut(entries: DataFrame, large: DataFrame | None) -> DataFrame:
    """Entries of a word in `large` dealt to blocks of BUFFER: each two blocks meet under a word of their own, the one asked for
    and the other asking, so that no task holds all entries of a word."""
    if large is None:
        return entries
    marked = entries.join(F.broadcast(large), "word", "left")
    whole = marked.where("n IS NULL").select(*entries.columns)
    number = F.ceil(F.col("n") / BUFFER).cast("int")
    rows = marked.where("n IS NOT NULL").withColumns({"_own": F.pmod(F.xxhash64(F.lit("block"), "name"), number).cast("int"), "_with": F.explode(F.sequence(F.lit(0), number - 1))})
    sides = []
    for bit, cell in ((1, ("_own", "_with")), (2, ("_with", "_own"))):
        word, place = F.xxhash64("word", *cell).alias("word"), F.col("place").bitwiseAND(F.lit(-4 + bit)).alias("place")
        sides.append(rows.where(F.col("place").bitwiseAND(F.lit(bit)) != 0).select(*[{"word": word, "place": place}.get(c, F.col(c)) for c in entries.columns]))
    return whole.unionByName(sides[0]).unionByName(sides[1])


def clusters(rows: DataFrame, words: int, t: float = SIMILARITY) -> DataFrame:
    """name (half of a set's) and cluster of the sets that can match another: sets of different clusters don't match. Entries
    with the four parts of the sketches laid over each other tell which sets have any candidate; those few then meet with their whole sketches.
    words: how many all texts have, which bound what a bucket of entries holds."""
    own, buckets = rows.where(F.col("entries").isNotNull()), max(words // BUCKET, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = _large(own)
    some = materialise(_met(own, [functools.reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, _SKETCH))], buckets, large, t, False).distinct(), "line-some")
    few = own.select("n1", "size", *_SKETCH, "entries", "hot").join(some, F.col("n1") == F.col("name"), "left_semi")
    edges = materialise(_met(few, [F.col(k) for k in _SKETCH], buckets, large, t, True), "line-edges")
    found = materialise(components(edges), "line-clusters")
    discard(some, edges, *([large] if large is not None else []))
    return found.select(F.col("node").alias("name"), F.col("component").alias("cluster"))


def _filter_places(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(n1.view(np.uint64) + n2.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _needed_bits(nodes: DataFrame) -> np.ndarray:
    """A bit for each of nodes(n1, n2); FILTER_BITS bound what is gathered and broadcast."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_filter_places(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))))
            yield pa.RecordBatch.from_pydict({"word": at >> 6, "bits": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    for word, value in nodes.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits")).toLocalIterator():
        bits[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return bits


def _words_of(shared: Broadcast):
    """rows(m1, m2, text) -> the words of needed sets, from those rows in which one of them stands first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rows = shared.value
        inside = lambda bits, at: (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        for batch in _steps(batches):
            at = _filter_places(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            x = Lines(batch.column(2).take(pa.array(np.flatnonzero(inside(rows, at)))), None)
            hit = inside(sets, _filter_places(x.n1, x.n2)) & (x.size > 0)
            _, first = np.unique(np.stack([x.n1, x.n2], 1), axis=0, return_index=True)
            lines = np.sort(first[hit[first]])
            found = [np.sort(x.hashes[x.start[i] : x.start[i] + x.size[i]]).tobytes() for i in lines]
            yield pa.RecordBatch.from_pydict({"n1": _signed(x.n1[lines]), "n2": _signed(x.n2[lines]), "words": pa.array(found, pa.binary())})

    return run


_AT = ["late", "doc_id", "m1", "m2", "line"]
_PARTNERS = "n1 long, n2 long, links long, late boolean, doc_id long, m1 long, m2 long, line int, r1 long, r2 long"


def _matching(left: list[np.ndarray], right: list[np.ndarray] | None, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left; in right, or later in left if there is none) of the sets of words that match."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both])
    vocabulary, code = np.unique(np.concatenate(both), return_inverse=True)
    width = -(-len(vocabulary) // 64)
    bits = np.zeros((len(both), width), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(both)), sizes), code >> 6), np.left_shift(np.uint64(1), (code & 63).astype(np.uint64)))
    first = len(left) if right is not None else 0
    out = [], []
    step = max(1, SLAB // (max(1, len(both) - first) * width))
    for at in range(0, len(left), step):
        some = np.arange(at, min(at + step, len(left)))
        i, j = (x.ravel() for x in np.meshgrid(some, np.arange(first, len(both)), indexing="ij"))
        keep = np.minimum(sizes[i], sizes[j]) >= t * np.maximum(sizes[i], sizes[j]) - 1e-9
        if right is None:
            keep &= i < j
        i, j = i[keep], j[keep]
        shared = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        good = shared >= t * (sizes[i] + sizes[j] - shared) - 1e-9
        out[0].append(i[good])
        out[1].append(j[good] - first)
    return np.concatenate(out[0]), np.concatenate(out[1])


def _verify(t: float):
    """The sets of a cell: their words, where they first stand, and their side (0 both, 1 left, 2 right) -> for each set with a
    match its number of matches here, the earliest of them, and a set that they are all joined with."""

    def run(cell: pa.Table) -> pa.Table:
        name = [cell.column(c).to_numpy() for c in ("n1", "n2")]
        late = np.asarray(pc.is_null(cell.column("doc_id")))
        doc = pc.fill_null(cell.column("doc_id"), 0).to_numpy()
        m1, m2, line = (cell.column(c).to_numpy() for c in ("m1", "m2", "line"))
        rank = np.empty(cell.num_rows, np.int64)
        by = np.lexsort((line, m2, m1, doc, late))
        rank[by] = np.arange(len(by))
        side, words = cell.column("side").to_numpy(), cell.column("words")
        cluster = cell.column("cluster").to_numpy()
        order = np.argsort(cluster, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))[1:]
        left, right = [], []
        for rows in np.split(order, edges):
            sides = [rows[side[rows] == k] for k in range(3)]
            of = lambda x: [np.frombuffer(words[int(k)].as_py(), np.uint64) for k in x]
            if len(sides[0]) > 1:
                i, j = _matching(of(sides[0]), None, t)
                left.append(sides[0][i])
                right.append(sides[0][j])
            if len(sides[1]) and len(sides[2]):
                i, j = _matching(of(sides[1]), of(sides[2]), t)
                left.append(sides[1][i])
                right.append(sides[2][j])
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
        links = np.bincount(a, minlength=len(rank)) + np.bincount(b, minlength=len(rank))
        least = np.full(len(rank), len(rank))
        np.minimum.at(least, a, rank[b])
        np.minimum.at(least, b, rank[a])
        root = roots(len(rank), a, b)
        some = np.flatnonzero(links)
        other = by[least[some]]
        return pa.table({
            **{f"n{k + 1}": x[some] for k, x in enumerate(name)},
            "links": links[some], "late": late[other], "doc_id": cell.column("doc_id").take(pa.array(other)),
            "m1": m1[other], "m2": m2[other], "line": line[other],
            **{f"r{k + 1}": x[root[some]] for k, x in enumerate(name)},
        })

    return run


def _cells(rows: DataFrame) -> DataFrame:
    """Rows(cluster, ...) of sets by cell (part), with their side: clusters of at most CELL sets are in one cell with others
    like them, larger ones cut into blocks, each two of which make a cell."""
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    large = materialise(sizes.where(F.col("_n") > CELL), "line-large")
    if not large.count():
        return rows.withColumns({"part": F.xxhash64("cluster"), "side": F.lit(0)})
    marked = rows.join(large, "cluster", "left")
    whole = marked.where("_n IS NULL").withColumns({"part": F.xxhash64("cluster"), "side": F.lit(0)})
    blocks = F.ceil(F.col("_n") / CELL).cast("int")
    cut = marked.where("_n IS NOT NULL").withColumn("_own", F.pmod(F.xxhash64("n1", "n2"), blocks).cast("int"))
    cut = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("_own") == F.col("_with"), 0).when(F.col("_own") < F.col("_with"), 1).otherwise(2)
    cut = cut.withColumns({"part": F.xxhash64("cluster", F.least("_own", "_with"), F.greatest("_own", "_with")), "side": side})
    return whole.unionByName(cut.select(*whole.columns)).drop("_n")


def partners(docs: DataFrame, sets: DataFrame, found: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """n1, n2, links (the number of other sets that match), the place of the earliest of these, and r1, r2 (a set of the same
    component of matches): of each set with a match, perhaps in several rows. sets(n1, n2, first); found: their clusters."""
    spark = docs.sparkSession
    held = sets.join(found, F.col("n1") == F.col("name")).select("n1", "n2", "cluster", *[F.col(f"first.{c}").alias(c) for c in _AT])
    held = materialise(held, "line-held")
    bits = _needed_bits(held.select("n1", "n2")), _needed_bits(held.select(F.col("m1").alias("n1"), F.col("m2").alias("n2")))
    shared = spark.sparkContext.broadcast(bits)
    words = _marked(docs, "text").select("m1", "m2", "text").mapInArrow(released(_words_of(shared)), "n1 long, n2 long, words binary")
    words = words.groupBy("n1", "n2").agg(F.first("words").alias("words"))
    rows = materialise(held.join(words, ["n1", "n2"]), "line-words")
    shared.destroy()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // CELL, 1)
    dealt = _cells(rows).withColumn("part", F.when(F.col("side") == 0, F.xxhash64(F.pmod("part", F.lit(parts)))).otherwise(F.col("part")))
    out = materialise(dealt.groupBy("part").applyInArrow(_verify(t), _PARTNERS), "line-partners")
    discard(held, rows)
    return out


def _marked(docs: DataFrame, *more) -> DataFrame:
    """Rows by id and 128 bits of id and text."""
    marks = [F.xxhash64("doc_id", "text").alias("m1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("m2")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *marks, *more)


_ROW = ["doc_id", "m1", "m2"]


def _place(line: str = "line") -> F.Column:
    """Where a line stands; comparable."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "m1", "m2", line)


def _linked(docs: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines, the partners of their sets, and the sets that stand in several lines or have a partner."""
    frequency = counters.count(docs.select("text"), _word_list, COUNTERS)
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(frequency, 2**31 - 1).astype(np.int32))
    rows = materialise(_marked(docs, "text").select(*_ROW, "text").mapInArrow(released(_line_rows(shared, t, BUFFER)), _LINES), "lines-whole")
    shared.destroy()
    found = clusters(rows, int(frequency.sum()), t)
    # lines of sets that stand in several lines or have a candidate; no other matters from here on
    names = rows.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).join(found.select("name", F.lit(True).alias("some")), F.col("n1") == F.col("name"), "left")
    lines = materialise(rows.select(*_ROW, "line", "n1", "n2").join(names.where("n > 1 OR some").select("n1", "n2", "n"), ["n1", "n2"]), "lines")
    discard(rows)
    sets = materialise(lines.groupBy("n1", "n2").agg(F.min(_place()).alias("first"), F.first("n").alias("n")), "line-sets")
    found = partners(docs, sets, found, t)
    linked = found.groupBy("n1", "n2").agg(F.sum("links").alias("links"), F.min(F.struct(*_AT)).alias("other"))
    some = materialise(sets.join(linked, ["n1", "n2"], "left").where("n > 1 OR links IS NOT NULL"), "line-known")
    discard(sets)
    return lines.drop("n"), found, some


def _removed(lines: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, m1, m2, line, links, source (the id where the earliest match stands), gone: of each line with a match."""
    least = sets.select("n1", "n2", F.coalesce(F.least("first", "other"), "first").alias("least"), F.coalesce("links", F.lit(0)).alias("links"))
    met = lines.join(least, ["n1", "n2"])
    return met.select(*_ROW, "line", "links", F.col("least.doc_id").alias("source"), (_place() > F.col("least")).alias("gone"))


def _pair(x: str, y: str) -> F.Column:
    return F.concat_ws(" ", F.col(x), F.col(y))


def _components(lines: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """m1, m2 and class_id (the least id) of the documents of each class: those that are joined by lines with equal or
    linked sets, over any number of steps. Of a component of sets, every document meets one, so no pairs are spelled out."""
    groups = components(found.select(_pair("n1", "n2").alias("a"), _pair("r1", "r2").alias("b")))
    groups = sets.select("n1", "n2", _pair("n1", "n2").alias("node")).join(groups, "node", "left").select("n1", "n2", F.coalesce("component", "node").alias("group"))
    held = materialise(lines.select(*_ROW, "n1", "n2").join(groups, ["n1", "n2"]).select(*_ROW, "group").distinct(), "line-groups")
    hubs = held.groupBy("group").agg(F.min(_pair("m1", "m2")).alias("b"))
    classes = materialise(components(held.join(hubs, "group").select(_pair("m1", "m2").alias("a"), "b")), "line-classes")
    own = F.split("node", " ")
    marks = classes.select(own[0].cast("long").alias("m1"), own[1].cast("long").alias("m2"), "component")
    # a document whose lines nobody else holds is alone
    rows = held.select(*_ROW).distinct().join(marks, ["m1", "m2"])
    least = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "component").select("m1", "m2", "class_id")


def _n_lines() -> F.Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _per_row(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, m1, m2, source, n_lines, n_links and removed of every row of docs."""
    per = removed.groupBy("m1", "m2", "line").agg(F.first("links").alias("links"), F.first("source").alias("source"), F.first("gone").alias("gone"))
    per = per.groupBy("m1", "m2").agg(F.sum("links").alias("links"), F.min("source").alias("source"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))
    rows = _marked(docs, _n_lines().alias("n_lines"))
    out = rows.join(per, ["m1", "m2"], "left")
    return out.select(
        *_ROW,
        F.least(F.coalesce("source", "doc_id"), "doc_id").alias("source"),
        "n_lines",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def matches(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, class_id (the least id in which one of its lines, or a match of
    one, stands first; its own without any: one step, which `classes` carries on), n_lines, n_links (matching sets of its
    lines, equal ones aside), removed (the numbers of the lines that go, from 0)."""
    out = _per_row(docs, _removed(*_linked(docs, t)))
    return out.select("doc_id", F.col("source").alias("class_id"), "n_lines", "n_links", "removed")


def classes(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """The rows of `matches` with class_id the least id of a row's whole class: of all documents that equal or matching
    lines join, over any number of steps. source is the one-step id that `matches` gives."""
    found = _linked(docs, t)
    out = _per_row(docs, _removed(*found)).join(_components(*found), ["m1", "m2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_lines", "n_links", "removed", "source")


def deduplicate(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """docs with the texts that remain; a null text stays null."""
    gone = _removed(*_linked(docs, t)).where("gone").groupBy("m1", "m2").agg(F.collect_set("line").alias("_gone"))
    gone = materialise(gone, "lines-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    names = docs.columns
    rows = _marked(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text").join(gone, ["m1", "m2"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains("_gone", k)), "\n")
    return rows.select(F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("_kept"), "_row").select(
        *[F.col("_kept").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names]
    )

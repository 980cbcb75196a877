"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set: its shingles of five words (lower-cased, split at ASCII white space), each weighing how often
it occurs times an inverse document frequency. The frequencies are exact: blocks of documents send their shingles' 64-bit
hashes through one shuffle by ranges of hashes, get back how many documents hold each, and keep for each document with a
shared shingle its frequencies, packed. The logarithm is scaled to lie between `IDF_FLOOR` and 1: an edit makes shingles
that nobody shares, and in a group of thousands of near copies an unbounded one would outweigh all that the copies have in
common. Equal sets are one node. Each node's samples form bands; nodes that share a band are candidates, and candidates are verified by the weighted
Jaccard similarity of their whole texts.

Within a band's bucket the pairs aren't spelled out. First each node meets one node, the least of its buckets'
leaders. In buckets that still hold several
components, nodes outside the largest are compared with all others in place, by sums of their weights in `BINS` bins: these
bound the similarity from above, so no pair that can be similar is lost, and what is left of pairs is verified, each node's
most similar partner first. So every candidate pair is either verified, or can't be similar, or is already in one component,
and the classes are those of all candidate pairs, while a group of n near copies costs about n verifications.

Defined results: null and empty texts, and those of white space, have no shingles and are each a class of their own unless
rows are alike in that too (all of them have the class of the least such id: they are equal texts); a text of one to four
words is one shingle; repeated rows share a class, and `deduplicate` keeps one row of a class even if ids repeat; null ids
sort last; an empty table gives an empty result; other columns are ignored by `classes` and returned by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.components import components
from voxlake.llm.scratch import discard, give_back, materialise, released
from voxlake.llm.shingles import mix, shingles

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
IDF_FLOOR = 0.75
#: Entries of the table of random draws that the samples come from.
DRAWS = 1 << 16
#: Documents and shingles (about) of a block whose shingles are counted together, and shingles (about) of a range of hashes.
BLOCK_DOCS, BLOCK_SHINGLES, RANGE_SHINGLES = 4096, 1 << 19, 1 << 20
#: Bytes of text for each shingle, for the number of ranges.
SHINGLE_BYTES = 6
#: Documents that one step of the sampling holds at once.
STEP = 512
#: Tables are broadcast up to this many rows and bytes, and joined by shuffle beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 150_000, 32 << 20
#: A node in HUB_PAIRS pairs and in one of HUBS of all pairs is a hub: there are at most HUBS.
HUB_PAIRS, HUBS = 200, 400
#: Bins of the sums that bound a similarity, and nodes on a side of a cell.
BINS, CELL = 512, 1024


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _factor(frequency: np.ndarray, number: int) -> np.ndarray:
    """The weight of one occurrence of shingles that `frequency` of `number` documents hold."""
    number = max(number, 2)
    scaled = np.log(number / np.clip(frequency, 1, number)) / np.log(number)
    return (IDF_FLOOR + (1 - IDF_FLOOR) * scaled).astype(np.float32)


def idf(docs: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """The factors of hashes, from a count on the driver: for small tables, to compare with."""
    found = [h for batch in docs.select("text").toArrow().to_batches() for h, _ in shingles(batch.column(0), WIDTH)]
    hashes, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    table, number = dict(zip(hashes.tolist(), counts.tolist(), strict=True)), len(found)
    return lambda x: _factor(np.array([table.get(h, 1) for h in x.tolist()], np.int64), number)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of one weight stand together, which compresses best."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_SENT = "part int, block long, range int, owners binary, hashes binary"
_COUNTED = "block long, range int, owners binary, found binary"
_FREQUENCIES = "m1 long, m2 long, frequency binary"


def _send(bits: int):
    """rows(m1, m2, text) -> for each block and range of hashes its shingles, by document and hash, and their documents as
    steps; and one row for each block (range -1) with its number of shingles and its rows' identities."""

    def close(ordinal: int, rows: list[tuple[int, int]], sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.array(rows, np.int64).reshape(-1, 2)
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        # blocks of equal rows are blocks of their own; a task that runs again gives the same names
        block = xxhash.xxh3_64_intdigest(keys.tobytes() + np.array([TaskContext.get().partitionId(), ordinal]).tobytes()) - (1 << 63)
        at = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        order = np.argsort(at, kind="stable")
        hashes, owner, at = hashes[order], owner[order], at[order]
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        spans = list(zip(edges.tolist(), [*edges[1:].tolist(), len(at)][: len(edges)], strict=True))
        own = np.append(len(hashes), keys.ravel()).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*at[edges].tolist(), block % (1 << bits)], pa.int32()),
                pa.array([block] * (len(spans) + 1), pa.int64()),
                pa.array([*at[edges].tolist(), -1], pa.int32()),
                pa.array([*(_pack(np.diff(owner[x:y], prepend=0).astype(np.int32)) for x, y in spans), _pack(own)], pa.binary()),
                pa.array([*(_pack(hashes[x:y]) for x, y in spans), None], pa.binary()),
            ],
            ["part", "block", "range", "owners", "hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal, size, rows, sets = 0, 0, [], []
        for batch in _slices(batches):
            for m1, m2, (hashes, _) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles(batch.column(2), WIDTH), strict=True):
                if not len(hashes):
                    continue
                rows.append((m1, m2))
                sets.append(hashes)
                size += len(hashes)
                if size >= BLOCK_SHINGLES or len(rows) >= BLOCK_DOCS:
                    yield close(ordinal, rows, sets)
                    ordinal, size, rows, sets = ordinal + 1, 0, [], []
        if rows:
            yield close(ordinal, rows, sets)

    return run


def _count(sent: pa.Table) -> pa.Table:
    """The shingles of one range of hashes, from all blocks, and in how many documents each is."""
    give_back()
    own = sent.filter(pc.greater_equal(sent.column("range"), 0))
    others = sent.filter(pc.less(sent.column("range"), 0))
    found: list[bytes] = []
    if own.num_rows:
        parts = [_unpack(x.as_py(), np.uint64) for x in own.column("hashes")]
        _, place, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        found = [_pack(x) for x in np.split(counts[place].astype(np.int32), ends)]
    whole = pa.concat_tables([own, others]).select(["block", "range", "owners"])
    return whole.append_column("found", pa.array([*found, *[None] * others.num_rows], pa.binary()))


def _gather(counted: pa.Table) -> pa.Table:
    """m1, m2 and frequencies (of its shingles, by hash) of the documents of one block that share a shingle."""
    give_back()
    rows = sorted(zip(counted.column("range").to_pylist(), counted.column("owners").to_pylist(), counted.column("found").to_pylist(), strict=True), key=lambda r: r[0])
    if not rows or rows[0][0] != -1 or (len(rows) > 1 and rows[1][0] == -1):
        raise RuntimeError("a block of shingles isn't whole: its rows were read in another grouping; materialise the input")
    own = _unpack(rows[0][1], np.int64)
    keys = own[1:].reshape(-1, 2)
    owner = np.concatenate([np.cumsum(_unpack(o, np.int32)) for _, o, _ in rows[1:]])
    found = np.concatenate([_unpack(f, np.int32) for _, _, f in rows[1:]])
    if len(found) != own[0]:
        raise RuntimeError("a block of shingles isn't whole: its rows were read in another grouping; materialise the input")
    found = found[np.argsort(owner, kind="stable")]
    per = np.split(found, np.cumsum(np.bincount(owner, minlength=len(keys)))[:-1])
    some = [k for k, x in enumerate(per) if x.max() > 1]
    return pa.table({"m1": pa.array(keys[some, 0], pa.int64()), "m2": pa.array(keys[some, 1], pa.int64()), "frequency": pa.array([_pack(per[k]) for k in some], pa.binary())})


def frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    """m1, m2 and frequency (packed: of its distinct shingles by hash, the number of rows of docs that hold each) of every
    row with a shingle that others hold, rows of one identity once; and the number of rows. All other frequencies are 1."""
    number, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHINGLE_BYTES // RANGE_SHINGLES, 1)
    sent = _keyed(docs, "text").mapInArrow(released(_send((ranges - 1).bit_length())), _SENT)
    counted = sent.groupBy("part").applyInArrow(_count, _COUNTED)
    found = counted.groupBy("block").applyInArrow(_gather, _FREQUENCIES)
    return materialise(found.dropDuplicates(["m1", "m2"]), "near-frequencies"), number


def _of(packed: pa.Array, sizes: list[int]) -> list[np.ndarray]:
    """The frequencies of texts with so many shingles."""
    found = [_unpack(x, np.int32) if x is not None else np.ones(n, np.int32) for x, n in zip(packed.to_pylist(), sizes, strict=True)]
    if any(len(x) != n for x, n in zip(found, sizes, strict=True)):
        raise RuntimeError("frequencies don't belong to a text's shingles")
    return found


class _Sampler:
    """Consistent weighted samples: for each of BANDS * ROWS draws the element with the least a = c / (y e^r), where
    ln y = r (t - beta) and t = floor(ln w / r + beta); r and c are Gamma(2, 1) and beta is uniform, by the element's hash."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        self.r = rng.gamma(2, 1, DRAWS).astype(np.float32)
        self.inverse = 1 / self.r
        self.beta = rng.random(DRAWS, np.float32)
        self.log_c = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.uint64(64 - DRAWS.bit_length() + 1)

    def bands(self, hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(documents, BANDS) hashes. sizes: elements of each document, none 0."""
        log_w = np.log(weights)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), BANDS), np.uint64)
        for k, odd in enumerate(self.odd):
            at = ((hashes * odd) >> self.shift).astype(np.int32)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(log_w * self.inverse[at] + beta)
            a = self.log_c[at] - r * (t - beta + 1)
            least = np.minimum.reduceat(a, starts)
            hits = np.flatnonzero(a == least[owner])
            _, first = np.unique(owner[hits], return_index=True)  # ties: the smallest hash, as hashes ascend
            hit = hits[first]
            band = k // ROWS
            out[:, band] = mix(out[:, band] + mix(hashes[hit] + mix(t[hit].astype(np.int64).view(np.uint64) + np.uint64(k + 1))))
        return out


_SIGNATURES = "doc_id long, m1 long, m2 long, node string, weight double, bands array<long>"


def _sign(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _Sampler()
        with np.errstate(over="ignore"):
            for batch in _slices(batches):
                sets = [*shingles(batch.column(3), WIDTH)]
                sizes = np.array([len(h) for h, _ in sets])
                some = np.flatnonzero(sizes)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                totals = np.zeros(len(sets))
                if len(some):
                    hashes = np.concatenate([h for h, _ in sets])
                    weights = np.concatenate([n for _, n in sets]).astype(np.float32) * _factor(np.concatenate(_of(batch.column(4), sizes.tolist())), number)
                    bands[some] = sampler.bands(hashes, weights, sizes[some])
                    totals[some] = np.add.reduceat(weights.astype(np.float64), (np.cumsum(sizes) - sizes)[some])
                nodes = [xxhash.xxh3_128_hexdigest(h.tobytes() + n.tobytes()) for h, n in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(sizes > 0, BANDS, 0))).astype(np.int32)), pa.array(bands[some].ravel().view(np.int64)))
                columns = [*(batch.column(k) for k in range(3)), pa.array(nodes), pa.array(totals), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "m1", "m2", "node", "weight", "bands"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / max(a[1].sum() + b[1].sum() - shared, 1e-300))


def weighted(texts: pa.Array, factor: Callable[[np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(h, n * factor(h).astype(np.float64)) for h, n in shingles(texts, WIDTH)]


def _compare(number: int, similarity: float):
    """rows(a, b, text_a, text_b, frequency_a, frequency_b) -> a, b of those that are similar. A text is read once for each
    run of rows with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                names = [part.column(k).to_pylist() for k in (0, 1)]
                texts: dict[str, tuple[str, bytes | None]] = {}
                for k in (0, 1):
                    for i, name in enumerate(names[k]):
                        if name not in texts:
                            texts[name] = part.column(2 + k)[i].as_py(), part.column(4 + k)[i].as_py()
                found = [*shingles(pa.array([t for t, _ in texts.values()], pa.string()), WIDTH)]
                often = _of(pa.array([f for _, f in texts.values()], pa.binary()), [len(h) for h, _ in found])
                sets = {x: (h, n * _factor(f, number).astype(np.float64)) for x, (h, n), f in zip(texts, found, often, strict=True)}
                good = [(a, b) for a, b in zip(*names, strict=True) if weighted_jaccard(sets[a], sets[b]) >= similarity - 1e-9]
                if good:
                    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in good], "b": [b for _, b in good]})

    return run


def _size(rows: DataFrame) -> int:
    """Bytes of a table of texts or frequencies, about."""
    wide = [F.octet_length(c) for c in ("text", "frequency") if c in rows.columns]
    return rows.agg(F.coalesce(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(64))), F.lit(0))).first()[0]


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """A row's identity in 128 bits, of id and text, for ids that are null or repeat."""
    return docs.select(F.xxhash64("doc_id", "text").alias("m1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("m2"), *more)


def _bins(number: int):
    """rows(node, text, frequency) -> node and its weights summed up in BINS bins of hashes, rounded up to 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [*shingles(batch.column(1), WIDTH)]
            often = _of(batch.column(2), [len(h) for h, _ in found])
            sums = [np.bincount((h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), n * _factor(f, number).astype(np.float64), BINS) for (h, n), f in zip(found, often, strict=True)]
            rows = [np.nextafter(np.minimum(s, 6e4).astype(np.float16), np.float16(np.inf)).tobytes() if s.max() < 6e4 else None for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["node", "bins"])

    return run


_MEMBERS = ["bucket", "node", "component", "weight", "bins", "asks"]


def _near_bins(x: np.ndarray, y: np.ndarray, total: np.ndarray, of: np.ndarray, similarity: float) -> np.ndarray:
    """The greatest weighted Jaccard similarity that each of x can have with each of y, by their bins; totals are weights."""
    out = np.zeros((len(x), len(y)), np.float32)
    for i in range(len(x)):
        shared = np.minimum(np.minimum(x[i], y).sum(1), np.minimum(total[i], of))
        out[i] = shared / np.maximum(total[i] + of - shared, 1e-30)
    return out


def _meet(similarity: float, best: bool):
    """Members of buckets, all of a cell's together -> a, b: nodes of different components in one bucket that can be similar
    by their bins; if best, for each asking node and bucket only the one that can be the most similar."""

    def run(cell: pa.Table) -> pa.Table:
        give_back()
        bucket = cell.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        component = cell.column("component").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        weight = cell.column("weight").to_numpy()
        asks = cell.column("asks").to_numpy()
        nodes, bins = cell.column("node"), cell.column("bins")
        left: list[int] = []
        right: list[int] = []
        for rows in np.split(order, edges[1:]):
            ask = rows[asks[rows] < 2]
            all_ = rows[asks[rows] > 0]
            if not len(ask) or not len(all_):
                continue
            full = np.full(BINS, np.inf, np.float32)
            y = np.stack([full if (v := bins[int(k)].as_py()) is None else np.frombuffer(v, np.float16).astype(np.float32) for k in all_])
            x = np.stack([full if (v := bins[int(k)].as_py()) is None else np.frombuffer(v, np.float16).astype(np.float32) for k in ask])
            bound = _near_bins(x, y, weight[ask], weight[all_], similarity)
            bound[component[ask][:, None] == component[all_][None, :]] = -1
            if best:
                at = bound.argmax(1)
                good = bound[np.arange(len(ask)), at] >= similarity - 1e-3
                left += ask[good].tolist()
                right += all_[at[good]].tolist()
            else:
                i, j = np.nonzero(bound >= similarity - 1e-3)
                left += ask[i].tolist()
                right += all_[j].tolist()
        return pa.table({"a": nodes.take(pa.array(left, pa.int64())), "b": nodes.take(pa.array(right, pa.int64()))})

    return run


class _Job:
    def __init__(self, docs: DataFrame, similarity: float) -> None:
        self.docs, self.similarity = docs, similarity
        self.frequencies, self.number = frequencies(docs)
        rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").join(self.frequencies, ["m1", "m2"], "left")
        rows = rows.select("doc_id", "m1", "m2", "text", "frequency")
        signed = materialise(rows.mapInArrow(released(_sign(self.number)), _SIGNATURES), "near-signatures")
        self.signed = materialise(signed.drop("weight", "bands"), "near-rows")
        nodes = signed.groupBy("node").agg(F.min(F.struct("m1", "m2")).alias("row"), F.min("weight").alias("weight"), F.min("bands").alias("bands"))
        buckets = nodes.select("node", "weight", "row", F.posexplode("bands").alias("band", "value"))
        buckets = buckets.select(F.xxhash64("band", "value").alias("bucket"), "node", "weight", "row")
        first = F.min(F.struct(F.xxhash64("node").alias("order"), "node", "weight")).alias("lead")
        shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), first).where("_n > 1").drop("_n")
        self.buckets = materialise(buckets.join(shared, "bucket"), "near-buckets")
        discard(signed)
        rows = self.buckets.select("node", "row.m1", "row.m2").distinct().join(self.frequencies, ["m1", "m2"], "left")
        self.nodes_ = materialise(rows, "near-nodes")
        discard(self.frequencies)

    def near(self, x: str, y: str) -> F.Column:
        return F.least(x, y) >= F.greatest(x, y) * (self.similarity - 1e-9)

    def texts(self, needed: DataFrame) -> DataFrame:
        """node, text and frequency of needed(node), each once."""
        rows = materialise(self.nodes_.join(needed, "node", "left_semi"), "near-needed")
        if rows.count() <= BROADCAST_ROWS and _size(rows) <= BROADCAST_BYTES:
            rows = F.broadcast(rows)
        return _keyed(self.docs, "text").join(rows, ["m1", "m2"]).groupBy("node").agg(F.first("text").alias("text"), F.first("frequency").alias("frequency"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that are similar. Nodes in so many pairs that one task would get them all are few, by the
        number they must reach; where their texts are small, too, these are broadcast and their pairs stay in place."""
        pairs = materialise(pairs.distinct(), "near-pairs")
        number = pairs.count()
        if not number:
            return materialise(pairs.select("a", "b"), "near-edges")
        texts = materialise(self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "near-texts")
        named = lambda x, t: t.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"), F.col("frequency").alias(f"frequency_{x}"))
        met = pairs.groupBy("b").count().where(F.col("count") >= max(HUB_PAIRS, number // HUBS)).select("b")
        hubs = [r["b"] for r in met.limit(HUBS).collect()]
        some = texts.where(F.col("node").isin(hubs))
        if hubs and _size(some) > BROADCAST_BYTES:
            hubs = []
        both = pairs.where(~F.col("b").isin(hubs)).join(named("a", texts), "a").join(named("b", texts), "b")
        if hubs:
            both = both.unionByName(pairs.where(F.col("b").isin(hubs)).join(named("a", texts), "a").join(F.broadcast(named("b", some)), "b"))
        both = both.select("a", "b", "text_a", "text_b", "frequency_a", "frequency_b")
        edges = materialise(both.mapInArrow(released(_compare(self.number, self.similarity)), "a string, b string"), "near-edges")
        discard(pairs, texts)
        return edges

    def nodes(self) -> DataFrame:
        """node and component of every node with links."""
        # first each node meets one node: of its buckets' leaders the least
        star = self.buckets.where((F.col("lead.node") != F.col("node")) & self.near("weight", "lead.weight"))
        edges = self.verified(star.groupBy(F.col("node").alias("a")).agg(F.min("lead").alias("lead")).select("a", F.col("lead.node").alias("b")))
        found = materialise(components(edges), "near-components")

        # what is left is compared by bins in place: first each node's most similar partner, then all that can be similar
        bins = None
        for best in (True, False):
            open_ = materialise(self._open(found), "near-open")
            if bins is None:
                bins = materialise(self.texts(open_.select("node").distinct()).mapInArrow(released(_bins(self.number)), "node string, bins binary"), "near-bins")
            cells = self._cells(open_).join(bins, "node").select("part", *_MEMBERS)
            pairs = cells.groupBy("part").applyInArrow(_meet(self.similarity, best), "a string, b string")
            edges, found = self._with(edges, found, pairs)
            discard(open_)
        return found

    def _with(self, edges: DataFrame, found: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and components with those of pairs that are similar."""
        more = self.verified(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        both = materialise(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "near-edges")
        now = materialise(components(both), "near-components")
        discard(edges, found, more)
        return both, now

    def _members(self, found: DataFrame) -> DataFrame:
        rows = self.buckets.select("bucket", "node", "weight").join(found, "node", "left")
        return rows.withColumn("component", F.coalesce("component", "node"))

    def _open(self, found: DataFrame) -> DataFrame:
        """The members of buckets that hold several components, with the bucket's number of members (n), of those outside
        its largest component (k), and that component (most)."""
        members = self._members(found)
        sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        stats = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
        stats = stats.where("n > most.n").select("bucket", "n", (F.col("n") - F.col("most.n")).alias("k"), F.col("most.component").alias("most"))
        return members.join(stats, "bucket")

    def _cells(self, open_: DataFrame) -> DataFrame:
        """Members by cell (part): within a bucket the k nodes outside its largest component ask all n. A bucket of at most
        CELL members is in one cell with others like it; a larger one is a grid of cells, each with CELL of those that ask
        and CELL of all. asks: 0 asks, 1 both, 2 is asked."""
        per = lambda x: F.ceil(F.col(x) / CELL).cast("int")
        small = F.col("n") <= CELL
        rows = open_.withColumn("own", F.col("component") != F.col("most"))
        cells = max(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), open_.count() // CELL, 1)
        whole = rows.where(small).select(F.xxhash64(F.pmod(F.xxhash64("bucket"), F.lit(cells))).alias("part"), "bucket", "node", "component", "weight", F.when(F.col("own"), 1).otherwise(2).alias("asks"))
        large = rows.where(~small)
        at = lambda x: F.pmod(F.xxhash64("node"), per(x))
        asking = large.where("own").select("*", at("k").alias("i"), F.explode(F.sequence(F.lit(0), per("n") - 1)).alias("j"), F.lit(0).alias("asks"))
        asked = large.select("*", F.explode(F.sequence(F.lit(0), per("k") - 1)).alias("i"), at("n").alias("j"), F.lit(2).alias("asks"))
        grid = asking.unionByName(asked).select(F.xxhash64("bucket", "i", "j").alias("part"), "bucket", "node", "component", "weight", "asks")
        return whole.unionByName(grid)

    def labelled(self) -> DataFrame:
        """doc_id, m1, m2 and component of every row."""
        rows = self.signed.select("doc_id", "m1", "m2", "node").join(self.nodes(), "node", "left")
        return rows.withColumn("component", F.coalesce("component", "node")).drop("node")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, class_id (the least id of its class), class_size (rows)."""
    rows = materialise(_Job(docs, similarity).labelled(), "near-labels")
    groups = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(groups, "component").select("doc_id", "class_id", "class_size")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every class, that with the least id, with all its columns."""
    rows = _Job(docs, similarity).labelled()
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "m1", "m2")
    keepers = materialise(rows.groupBy("component").agg(F.min(order).alias("k")).select("k.m1", "k.m2"), "near-keepers")
    names = docs.columns
    whole = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    first = F.row_number().over(Window.partitionBy("m1", "m2").orderBy("m1"))
    return whole.join(keepers, ["m1", "m2"]).withColumn("_nth", first).where("_nth = 1").select("_row.*")

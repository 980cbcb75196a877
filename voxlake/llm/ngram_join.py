"""Jaccard self-join of documents' word n-grams: a size-aware heavy-light join, and the components of its links.

A document is the set of its distinct shingles. Equal sets are one node. Shingles are ordered by rarity (how often all documents
hold them, by hashed counters: these only order, so the result doesn't depend on them) and then by hash. Two similar sets
share at least k of the first n - o + k shingles of each, where n is a set's size and o the least overlap of similar sets.

* Light: sets up to a boundary size enumerate the subsets of `SUBSET` shingles of that prefix; similar ones share a subset.
* Heavy: sets above it, and those small ones that a set above it can be similar to, list each shingle of their prefix (k = 1) in
  an inverted list.
* The boundary minimises the cost of all sets: entries that a set writes, and what it scans in the lists of its shingles.

The lists and subsets are buckets of nodes. Pairs in buckets are candidates, under limits of length and position; no link is
lost. They aren't all spelled out: first each node meets the least node of each of its buckets. Pairs that are spelled out are held
against sketches first (sums of shingles in `BINS` bins), which bound the overlap from above. Buckets whose nodes are then one
component are closed. Of the others those of up to `SMALL` nodes give their pairs between components, each pair once; larger ones
are cut by classes of length and then into a grid of cells of bounded size. Every cell compares whole sets exactly, by scanning the
inverted lists of its own shingles. So a group of n near copies that are linked costs about n comparisons.

Defined results: words are runs without ASCII white space, A-Z lower-cased; fewer words than a shingle has are one shingle; null texts
and those without words are empty sets, linked with nothing (each its own component, whatever its id); repeated rows are equal
sets and so linked; texts are read whole; a component's id is its least doc_id, nulls aside, and null if all are; an empty table gives
an empty result; other columns are ignored. Ids are cast to long. Shingles are compared by 64-bit hashes and equal sets found by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import counters
from voxlake.llm.components import components
from voxlake.llm.scratch import discard, give_back, materialise, released
from voxlake.llm.shingles import shingles

WIDTH, SIMILARITY = 3, Fraction(90, 100)
#: Shingles of a light set's subsets, and the largest size that the boundary may have.
SUBSET, LIGHT_MOST = 2, 128
#: Counters that order shingles by rarity, and levels for each doubling of a count.
COUNTERS, LEVELS = 1 << 23, 8
#: Documents that a task holds at once.
STEP = 512
#: Nodes of a bucket whose pairs are spelled out; nodes and shingles on a side of a cell; shingles (about) of a part of cells.
SMALL, CELL, CELL_SHINGLES, PART_SHINGLES = 32, 512, 1 << 19, 1 << 20
#: Shingles of a cell compared at once.
CHUNK = 2048
#: Bins of the sums that bound an overlap, one byte each.
BINS = 256
#: Nodes whose texts are read again are broadcast up to this many rows (32 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [h for h, _ in shingles(texts, WIDTH, pc.ascii_lower)]


def least_overlap(similarity: Fraction, n: int, m: int) -> int:
    """Of similar sets of n and m elements."""
    return math.ceil(similarity * (n + m) / (1 + similarity))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _batch_counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(batch.column(0))]), return_counts=True)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)) * LEVELS, 255).astype(np.uint8)


def _sketch(h: np.ndarray) -> bytes:
    """How many shingles each bin of hashes has; 255 stands for that and more."""
    return np.minimum(np.bincount((h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _possible(similarity: Fraction):
    """rows(a, b, na, nb, sketch_a, sketch_b) -> a, b of those whose sketches don't rule out that they are similar."""
    top, both = similarity.numerator, similarity.numerator + similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.column(2).to_numpy().astype(np.int64) + part.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5))
                least = np.minimum(x, y)
                good = (least.sum(1, np.int64) * both >= top * n) | (least == 255).any(1)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(good)) for k in (0, 1)], ["a", "b"])

    return run


_SIGNED = "doc_id long, m1 long, m2 long, node binary, n int, tokens array<long>, scan double, sketch binary"


def _sign(levels, usual: float, similarity: Fraction):
    """rows(doc_id, m1, m2, text) -> the set's name and size, its rarest shingles (the prefix of light sets), and what scanning the
    lists of the prefix of heavy ones costs: counts above the usual one, which chance collisions of counters make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels.value, np.uint8)
        for batch in _slices(batches):
            names, sizes, tokens, scans, sketches = [], [], [], [], []
            for h in _sets(batch.column(3)):
                n = len(h)
                level = table[counters.places(h, COUNTERS)]
                # smaller sets can be similar to equal ones only
                take = n - math.ceil(similarity * n) + SUBSET if n >= similarity * (n + 1) else 0
                first = np.argsort(level, kind="stable")[:take]
                names.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(n)
                tokens.append(h[first])
                sketches.append(_sketch(h) if take else None)
                scans.append(float(np.maximum(2.0 ** (level[first[:-1]] / LEVELS) - usual, 0).sum()))
            ends = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)))
            columns = [*(batch.column(k) for k in range(3)), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(scans, pa.float64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "m1", "m2", "node", "n", "tokens", "scan", "sketch"])

    return run


def boundary(nodes: DataFrame, similarity: Fraction = SIMILARITY) -> int:
    """The size up to which sets are light: the least cost of entries and scans over all nodes(n, tokens, scan)."""
    rows = nodes.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("tokens")).alias("tokens"), F.sum("scan").alias("scan")).collect()
    found = {r["n"]: r for r in rows}

    def cost(most: int) -> float:
        total = 0.0
        for n, r in found.items():
            if n <= most:
                p = r["tokens"] // r["sets"]
                total += r["sets"] * math.comb(p, SUBSET)
            if n > most or n >= similarity * (most + 1):
                total += r["tokens"] - r["sets"] + r["scan"]
        return total

    return min(range(LIGHT_MOST + 1), key=cost)


def entries(nodes: DataFrame, light: int, similarity: Fraction = SIMILARITY) -> DataFrame:
    """key, id, n and at (the place of the shingle, or of a subset's last one, in the set's order) of nodes(id, n, tokens)."""
    least_heavy = math.ceil(similarity * (light + 1))
    own = nodes.where(F.size("tokens") > 0)
    heavy = own.where(F.col("n") >= least_heavy).select("id", "n", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - 1)).alias("at", "token"))
    heavy = heavy.select(F.xxhash64(F.lit(1), "token").alias("key"), "id", "n", "at")
    rows = own.where(F.col("n") <= light).select("id", "n", "tokens", F.posexplode("tokens").alias("first", "one"))
    rows = rows.select("id", "n", "first", "one", F.posexplode("tokens").alias("at", "two")).where("at > first")
    return heavy.unionByName(rows.select(F.xxhash64(F.lit(2), "one", "two").alias("key"), "id", "n", "at"))


def _can_link(a: str, b: str, similarity: Fraction):
    """Limits of length and position: the overlap of two sets that share a shingle at places at_a and at_b is at most those
    before it, itself and those after it."""
    n, m, i, j = (F.col(x).cast("long") for x in (f"n{a}", f"n{b}", f"at{a}", f"at{b}"))
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return most * (similarity.numerator + similarity.denominator) >= similarity.numerator * (n + m)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of left shares with each of right, by the lists of those that both sides hold."""
    def listed(sets, held):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(held, flat), max(len(held) - 1, 0))
        hit = np.flatnonzero(held[place] == flat) if len(held) else np.zeros(0, np.int64)
        return place[hit], owner[hit]

    held = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    token, owner = listed(left, held)
    if len(right) == 1:
        return np.bincount(owner, minlength=len(left))[:, None]
    other, of = listed(right, held)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(held), CHUNK):
        sides = []
        for t, o, count in ((token, owner, len(left)), (other, of, len(right))):
            here = (t >= at) & (t < at + CHUNK)
            marks = np.zeros((count, min(CHUNK, len(held) - at)), np.float32)
            marks[o[here], t[here] - at] = 1
            sides.append(marks)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def _link(similarity: Fraction):
    """Cells of nodes (side 0 and 1) -> a, b of those on two sides and of two components that are similar."""
    top, both = similarity.numerator, similarity.numerator + similarity.denominator

    def run(part: pa.Table) -> pa.Table:
        give_back()
        cell, side, ids, component = (part.column(c).to_numpy() for c in ("cell", "side", "id", "component"))
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(cell[order][1:] != cell[order][:-1]) + 1
        a, b = [], []
        for rows in np.split(order, edges):
            two = [rows[side[rows] == k] for k in (0, 1)]
            if not len(two[0]) or not len(two[1]):
                continue
            sets = [[np.frombuffer(part.column("elements")[int(k)].as_py(), np.uint64) for k in x] for x in two]
            sizes = [np.array([len(s) for s in x]) for x in sets]
            good = _overlaps(*sets) * both >= top * (sizes[0][:, None] + sizes[1][None, :])
            good &= component[two[0]][:, None] != component[two[1]][None, :]
            i, j = np.nonzero(good)
            a.append(ids[two[0][i]])
            b.append(ids[two[1][j]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


class _Job:
    def __init__(self, docs: DataFrame, similarity: Fraction, light: int | None) -> None:
        self.docs, self.similarity = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), similarity
        counts = counters.count(self.docs.select("text"), _batch_counts, COUNTERS)
        context = docs.sparkSession.sparkContext
        levels = context.broadcast(_levels(counts).tobytes())
        rows = self._keyed("doc_id", *self.ROW, "text")
        run = released(_sign(levels, 2 * counts.sum() / COUNTERS + 2, similarity))
        signed = materialise(rows.mapInArrow(run, _SIGNED), "ngram-signed")
        levels.destroy()
        self.signed = materialise(signed.select("doc_id", "node", "n"), "ngram-rows")
        found = signed.where(F.size("tokens") > 0).groupBy("node")
        found = found.agg(F.min(F.struct(*self.ROW)).alias("row"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("tokens", "scan", "sketch")])
        self.nodes = materialise(found.select(F.monotonically_increasing_id().alias("id"), "*"), "ngram-nodes")
        discard(signed)
        self.light = boundary(self.nodes, similarity) if light is None else light
        self.buckets = self._shared()

    #: A row's identity in 128 bits, for ids that are null or repeat.
    ROW = ("m1", "m2")

    def _keyed(self, *columns: str) -> DataFrame:
        names = {"m1": F.xxhash64("doc_id", "text"), "m2": F.xxhash64(F.lit("second"), "text", "doc_id")}
        return self.docs.withColumns(names).select(*columns)

    def _shared(self) -> DataFrame:
        """key, id, n, at, members and lead (the least id) of the buckets of two and more."""
        rows = entries(self.nodes, self.light, self.similarity)
        shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("lead")).where("members > 1")
        shared = materialise(shared, "ngram-keys")
        found = materialise(rows.join(shared, "key"), "ngram-buckets")
        discard(shared)
        return found

    def _elements(self, ids: DataFrame) -> DataFrame:
        """id and elements of the nodes of ids(id): their texts are read again."""
        needed = materialise(self.nodes.select("id", "row.m1", "row.m2").join(ids.select("id").distinct(), "id", "left_semi"), "ngram-needed")
        small = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # rows alike in all are one node's
            for batch in _slices(batches):
                first = [k for k, x in enumerate(batch.column(0).to_pylist()) if x not in seen and not seen.add(x)]
                own = batch.take(pa.array(first, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([s.tobytes() for s in _sets(own.column(1))], pa.binary())], ["id", "elements"])

        rows = self._keyed(*self.ROW, "text").join(small, list(self.ROW)).select("id", "text")
        found = materialise(rows.mapInArrow(released(run), "id long, elements binary").dropDuplicates(["id"]), "ngram-sets")
        discard(needed)
        return found

    def _linked(self, cells: DataFrame, total: int) -> DataFrame:
        """a and b of the similar nodes of cells(cell, side, id, component), a table. total: shingles, about, that they hold."""
        parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_SHINGLES)
        sets = self._elements(cells)
        rows = cells.join(sets, "id").withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts)))
        found = rows.select("part", "cell", "side", "id", "component", "elements").groupBy("part").applyInArrow(_link(self.similarity), "a long, b long")
        found = materialise(found, "ngram-links")
        discard(sets, cells)
        return found

    def _of_pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b), which are distinct, that are similar: b meets its partners in blocks."""
        own = lambda x: self.nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch_{x}"))
        met = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
        pairs = materialise(met.mapInArrow(_possible(self.similarity), "a long, b long"), "ngram-pairs")
        sizes = self.nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"))
        hubs = pairs.groupBy("b").count().join(sizes, "b")
        block = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_SHINGLES) / F.col("nb"))))
        hubs = materialise(hubs.select("b", "nb", "count", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "ngram-hubs")
        total = hubs.agg(F.coalesce(F.sum(F.col("nb") * (F.col("count") + F.col("blocks"))), F.lit(0))).first()[0]
        left = pairs.join(hubs, "b").select(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("blocks"))).alias("cell"), F.lit(0).alias("side"), F.col("a").alias("id"))
        right = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
        right = right.select(F.xxhash64("b", F.col("k").cast("long")).alias("cell"), F.lit(1).alias("side"), F.col("b").alias("id"))
        cells = materialise(left.unionByName(right).withColumn("component", F.col("id")), "ngram-cells")
        found = self._linked(cells, total)
        discard(pairs, hubs)
        return found

    def _stars(self) -> DataFrame:
        """Links between nodes and the leads of their buckets."""
        named = lambda x: self.buckets.select("key", "members", "lead", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "at")])
        leads = named("b").where("id_b = lead").drop("members", "lead")
        met = named("a").where("id_a <> lead").join(leads, "key").where(_can_link("_a", "_b", self.similarity))
        return self._of_pairs(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())

    def _open(self, found: DataFrame) -> DataFrame:
        """The members of buckets that hold several components."""
        rows = self.buckets.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        rows = materialise(rows, "ngram-members")
        several = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
        opened = materialise(rows.join(several, "key", "left_semi"), "ngram-open")
        discard(rows)
        return opened

    def _small(self, opened: DataFrame) -> DataFrame:
        """Links between components within buckets of few nodes."""
        rows = opened.where(F.col("members") <= SMALL)
        named = lambda x: rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "at", "component")])
        met = named("a").join(named("b"), "key").where("id_a > id_b AND component_a <> component_b").where(_can_link("_a", "_b", self.similarity))
        return self._of_pairs(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())

    def _large(self, opened: DataFrame) -> DataFrame | None:
        """Links between components within larger buckets: classes of length, then cells. Those outside a bucket's largest component
        ask, all are asked."""
        rows = opened.where(F.col("members") > SMALL)
        # sizes of similar sets are in one class or in two that follow each other
        step = math.log(1 / self.similarity) * (1 + 1e-9)
        rows = rows.withColumn("class", F.floor(F.ln("n") / step).cast("int"))
        ahead = F.explode(F.array(F.struct(F.col("class").alias("band"), F.lit(True).alias("own")), F.struct((F.col("class") + 1).alias("band"), F.lit(False).alias("own"))))
        rows = rows.select("key", "id", "n", "component", ahead.alias("e")).select("key", "id", "n", "component", "e.*")
        rows = materialise(rows, "ngram-large")
        if rows.isEmpty():
            return None
        sizes = rows.groupBy("key", "band", "component").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("own"), 1)).alias("owns"), F.max("n").alias("n"))
        stats = sizes.groupBy("key", "band").agg(F.sum("c").alias("all"), F.sum("owns").alias("own_all"), F.max("n").alias("most_n"), F.max(F.struct("c", "component", "owns")).alias("most"))
        # two of one class or of two: either of a pair may be the one outside the largest component
        block = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_SHINGLES) / F.col("most_n"))))
        stats = stats.where("own_all > 0 AND all > most.c").select("key", "band", F.col("most.component").alias("largest"), F.ceil((F.col("all") - F.col("most.c")) / block).cast("int").alias("asking"), F.ceil(F.col("all") / block).cast("int").alias("asked"))
        stats = materialise(stats, "ngram-grids")
        rows = rows.join(stats, ["key", "band"]).withColumn("place", F.xxhash64("id"))
        i, j = F.pmod("place", F.col("asking")), F.pmod("place", F.col("asked"))
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("component <> largest").select("*", i.cast("int").alias("i"), others("asked").alias("j"), F.lit(0).alias("side"))
        right = rows.select("*", others("asking").alias("i"), j.cast("int").alias("j"), F.lit(1).alias("side"))
        cells = left.unionByName(right).select(F.xxhash64("key", "band", "i", "j").alias("cell"), "side", "id", "component", "n")
        cells = materialise(cells, "ngram-cells")
        total = cells.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()[0]
        found = self._linked(cells, total)
        discard(rows, stats)
        return found

    def components(self) -> DataFrame:
        """node (an id) and component of all nodes with links."""
        stars = self._stars()
        found = materialise(components(stars), "ngram-components")
        opened = self._open(found)
        more = [x for x in (self._small(opened), self._large(opened)) if x is not None]
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        for x in more:
            edges = edges.unionByName(x)
        now = materialise(components(edges), "ngram-components")
        discard(stars, found, opened, *more)
        return now


def join(docs: DataFrame, similarity: Fraction = SIMILARITY, light: int | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles and component_id (the least id that links reach). light: the
    boundary in place of that of least cost."""
    job = _Job(docs, similarity, light)
    names = job.nodes.select("node", "id").join(job.components().withColumnRenamed("node", "id"), "id")
    names = materialise(names.select("node", "component"), "ngram-names")
    rows = job.signed.select("doc_id", "n", "node").join(names, "node", "left")
    group = F.when(F.col("component").isNull(), F.hex("node")).otherwise(F.col("component").cast("string"))
    rows = materialise(rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, group).alias("group")), "ngram-labels")
    least = materialise(rows.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least")), "ngram-least")
    return rows.join(least, "group", "left").select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc, CASE WHEN len(words) < 3 THEN words ELSE words[k : k + 2] END AS shingle
  FROM docs, unnest(range(1, greatest(len(words) - 1, 2))) AS t(k) WHERE len(words) > 0
), sizes AS (
  SELECT doc, count(*) AS n FROM sets GROUP BY ALL
), shared AS (
  SELECT a.doc AS a, b.doc AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc <> b.doc GROUP BY ALL
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc = s.a JOIN sizes y ON y.doc = s.b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)
), reach AS (
  SELECT doc AS a, doc AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc) JOIN reach r ON r.a = d.doc JOIN docs o ON o.doc = r.b GROUP BY d.doc, d.doc_id
"""

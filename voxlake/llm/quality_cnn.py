"""Quality classifier: a byte-level convolutional network in numpy.

Every byte is a fixed vector; learned filters slide over a document's bytes, two at a time. Chunks of `CHUNK` bytes
that overlap by half cover the whole document. A chunk is the strongest answer of every filter within it, a hidden layer
reads these, the chunks' hidden values are averaged, and one logistic unit gives the probability of label 1. Scoring is
row by row in Arrow batches, over every byte of every text.

Learning takes whole labelled documents, at most `SAMPLE` of each label, picked by hashes: a sample of bounded rows that
the driver fits, over all chunks of each. Which rows may be learned from is the caller's filter.

Defined results: a null text is empty, an empty text has one chunk of zero bytes and so a score like any other; labels that
are null, other than 0 and 1, or contradict each other aren't learned from; without both labels every score is 0.5; repeated
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.scratch import give_back

WIDTH, STRIDE, CHUNK, DIM, FILTERS, HIDDEN = 8, 2, 256, 12, 32, 16
HALF = CHUNK // 2
#: Labelled documents of each label that learning uses at most.
SAMPLE = 1200
EPOCHS, BATCH, RATE = 7, 48, 0.005
#: Beside the documents of a batch, a share of them is shown again as a short text: a span of bytes from anywhere in them.
SPANS, SPAN_BYTES = 0.35, (8, 200)
#: Chunks that learning holds the filters' answers of at once.
STEP = 512
#: Bytes that one pass of the filters takes, so that memory doesn't grow with texts.
SLAB = 1 << 18

_EMBEDDING = np.random.default_rng(7).normal(size=(256, DIM)).astype(np.float32)


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        f32 = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return cls(f32(WIDTH * DIM, FILTERS), zero(FILTERS), f32(FILTERS, HIDDEN), zero(HIDDEN), f32(HIDDEN, 1), zero(1))

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def _padded(data: bytes) -> np.ndarray:
    """Bytes with zeros up to a whole number of half chunks, at least one filter's width of them and one chunk in all."""
    size = max(CHUNK, -(-(len(data) + WIDTH) // HALF) * HALF)
    out = np.zeros(size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def _halves(data: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The strongest answer of every filter that starts in each half chunk. data: whole half chunks, then WIDTH zeros."""
    starts = len(data) - WIDTH
    out = np.zeros((starts // HALF, FILTERS), np.float32)
    step = SLAB // HALF
    for at in range(0, len(out), step):
        end = min(at + step, len(out))
        part = data[at * HALF : end * HALF + WIDTH]
        n = (end - at) * HALF
        total = tables[0][part[0:n:STRIDE]]
        for tap in range(1, WIDTH):
            total += tables[tap][part[tap : tap + n : STRIDE]]
        out[at:end] = total.reshape(end - at, HALF // STRIDE, FILTERS).max(1)
    return np.maximum(out + bias, 0)


def scores(texts: list[str | None], net: Network) -> np.ndarray:
    """Probabilities of label 1. Each depends on its own text alone: sums run within a document."""
    tables = np.stack([_EMBEDDING @ net.filters[tap * DIM : (tap + 1) * DIM] for tap in range(WIDTH)])
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and (not group or size < SLAB):
            group.append(_padded((texts[at + len(group)] or "").encode()))
            size += len(group[-1])
        # half a chunk of zeros follows each text: filters that start at its end see nothing of the next one
        gap = np.zeros(HALF, np.uint8)
        halves = _halves(np.concatenate([*(x for g in group for x in (g, gap)), np.zeros(WIDTH, np.uint8)]), tables, net.bias)
        counts = np.array([len(g) // HALF for g in group])
        ends = np.cumsum(counts + 1)
        chunks = np.maximum(halves[:-1], halves[1:])
        inside = np.ones(len(chunks), bool)
        inside[ends[:-1] - 1] = False
        inside[ends - 2] = False
        hidden = np.maximum(chunks[inside] @ net.hidden + net.hidden_bias, 0)
        firsts = np.cumsum(counts - 1) - (counts - 1)
        mean = np.add.reduceat(hidden, firsts, axis=0) / (counts - 1)[:, None]
        out[at : at + len(group)] = 1 / (1 + np.exp(-np.clip((mean @ net.out + net.out_bias)[:, 0], -30, 30)))
        at += len(group)
    return out


def _views(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The vectors under each filter place of the chunks that start there: (chunks, places, WIDTH * DIM)."""
    windows = np.lib.stride_tricks.sliding_window_view(data, CHUNK + WIDTH)[starts]
    vectors = _EMBEDDING[windows].reshape(len(starts), -1)
    return np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * DIM, axis=1)[:, :: DIM * STRIDE][:, : CHUNK // STRIDE]


def _learn_batch(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss over whole documents, as `_spaced` gives them. Every chunk is seen; a step of chunks at a
    time goes through the filters, once forth and, for the places that answered most strongly, once back."""
    counts = np.array([(len(t) - WIDTH) // HALF - 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    data = np.concatenate(texts)
    first = np.cumsum([0, *map(len, texts)])[:-1]
    starts = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * HALF
    n = len(owner)
    best, raw = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), np.float32)
    for at in range(0, n, STEP):
        view = _views(data, starts[at : at + STEP])
        answers = (np.ascontiguousarray(view).reshape(-1, WIDTH * DIM) @ net.filters).reshape(len(view), -1, FILTERS)
        best[at : at + STEP] = answers.argmax(1)
        raw[at : at + STEP] = np.take_along_axis(answers, best[at : at + STEP][:, None, :], 1)[:, 0] + net.bias
    pooled = np.maximum(raw, 0)
    pre = pooled @ net.hidden + net.hidden_bias
    hidden = np.maximum(pre, 0)
    share = (1 / counts[owner]).astype(np.float32)[:, None]
    mean = np.zeros((len(labels), HIDDEN), np.float32)
    np.add.at(mean, owner, hidden * share)
    p = 1 / (1 + np.exp(-np.clip((mean @ net.out + net.out_bias)[:, 0], -30, 30)))
    d = ((p - labels) / len(labels)).astype(np.float32)[:, None]
    g_out, g_out_bias = mean.T @ d, d.sum(0)
    d_hidden = (d @ net.out.T)[owner] * share * (pre > 0)
    g_hidden, g_hidden_bias = pooled.T @ d_hidden, d_hidden.sum(0)
    d_pooled = (d_hidden @ net.hidden.T) * (raw > 0)
    g_filters = np.zeros_like(net.filters)
    for at in range(0, n, STEP):
        own = starts[at : at + STEP]
        for f in range(FILTERS):
            places = (own + best[at : at + STEP, f] * STRIDE)[:, None] + np.arange(WIDTH)
            g_filters[:, f] += _EMBEDDING[data[places]].reshape(len(own), -1).T @ d_pooled[at : at + STEP, f]
    return [g_filters, d_pooled.sum(0), g_hidden, g_hidden_bias, g_out, g_out_bias]


def _spaced(data: bytes) -> np.ndarray:
    """A document's bytes as scoring sees them: whole half chunks, and zeros for filters that start at their end."""
    return np.concatenate([_padded(data), np.zeros(WIDTH, np.uint8)])


def _span(data: bytes, rng: np.random.Generator) -> bytes:
    size = int(np.exp(rng.uniform(*np.log(SPAN_BYTES))))
    at = rng.integers(max(1, len(data) - size + 1))
    return data[at : at + size]


def fit(samples: list[tuple[int, bytes]], seed: int = 0) -> Network | None:
    """Adam over samples (label, text in UTF-8), both labels weighing alike; None unless both are there."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    texts = [_spaced(x) for _, x in samples]
    labels = np.array([y for y, _ in samples], np.float32)
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    if not all(map(len, sides)):
        return None
    most = max(map(len, sides))
    weights, moments, step = net.weights(), [[np.zeros_like(w), np.zeros_like(w)] for w in net.weights()], 0
    batches = -(-2 * most // BATCH)
    for epoch in range(EPOCHS):
        order = np.stack([rng.permutation(np.resize(s, most)) for s in sides], 1).ravel()
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            again = rng.choice(pick, round(SPANS * len(pick)), replace=False)
            shown = [*(texts[i] for i in pick), *(_spaced(_span(samples[i][1], rng)) for i in again)]
            gradients = _learn_batch(net, shown, labels[np.concatenate([pick, again])])
            step += 1
            rate = RATE * (1 - step / (EPOCHS * batches + 1))
            for w, g, (m, v) in zip(weights, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learnable() -> Column:
    """Documents that labels may be learned from: crc32 of doc_id as text, mod 3, isn't 1."""
    return ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learn from docs(doc_id, text) and labels(doc_id, quality) where `learnable`: at most `sample` of each label."""
    known = labels.where(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_max"))
    known = known.where(F.col("label") == F.col("_max")).select("doc_id", "label")
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # rows that repeat an id could bring more than the bound
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return fit(sorted((r["label"], r["text"].encode()) for r in rows.toLocalIterator()))


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with quality_score, the probability of label 1; every other column is kept."""
    if net is None:
        return docs.withColumn("quality_score", F.lit(0.5))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series(scores(texts.tolist(), net))
        finally:
            give_back()

    return docs.withColumn("quality_score", probability("text"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts (a score of 0.5 or more), with their columns."""
    net, names = train(docs, labels), docs.columns
    rows = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text"), net)
    return rows.where("quality_score >= 0.5").select("_row.*")

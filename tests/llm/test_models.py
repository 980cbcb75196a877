"""The quality network, byte pair encoding and nearest neighbours."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from voxlake.llm import bpe, quality_cnn, vptree

# ---- quality ---------------------------------------------------------------------------------------------------------


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    for s in set(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r["doc_id"]: r for r in quality_cnn.judged(docs, labels).collect()}
    assert len(found) == docs.count()
    for r in found.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    known = [(r["quality"], found[r["doc_id"]]["score"]) for r in labels.collect() if r["doc_id"] in found and found[r["doc_id"]]["held_out"]]
    y, s = (np.array(x) for x in zip(*known, strict=True))
    assert auc(y, s) > 0.8


def test_quality_ignores_held_out_labels(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality_cnn.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_cnn.train(docs, x) for x in (labels, flipped))
    assert all((x == y).all() for x, y in zip(a.weights(), b.weights(), strict=True))


def test_quality_scores_whole_text_alone(spark):
    net = quality_cnn.Network.new(np.random.default_rng(1))
    texts = ["", None, "a", "b" * 1000, "long " * 200_000, "é" * 300]
    together = quality_cnn.scores(texts, net)
    assert np.allclose(together, [quality_cnn.scores([t], net)[0] for t in texts])
    end = quality_cnn.scores(["x" * 700_000, "x" * 699_990 + "ZQJ!% 0#~&"], net)
    assert end[0] != end[1]


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (5, 7), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    assert len(quality_cnn.judged(odd, labels).collect()) == odd.count()
    kept = quality_cnn.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.where("quality_score <> 'own'").count() == 0
    assert quality_cnn.judged(empty, labels).collect() == []
    none = quality_cnn.judged(odd, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}


def plain_score(text, net):
    """The network as loops over bytes, filters' places and chunks."""
    data = list((text or "").encode())
    half, width = quality_cnn.HALF, quality_cnn.WIDTH
    size = max(quality_cnn.CHUNK, -(-(len(data) + width) // half) * half)
    data += [0] * (size + width - len(data))
    hidden = []
    for start in range(0, size - half, half):
        best = np.full(quality_cnn.FILTERS, -np.inf)
        for at in range(start, start + quality_cnn.CHUNK, quality_cnn.STRIDE):
            seen = np.concatenate([quality_cnn._EMBEDDING[data[at + k]] for k in range(width)]).astype(np.float64)
            best = np.maximum(best, seen @ net.filters)
        hidden.append(np.maximum(np.maximum(best + net.bias, 0) @ net.hidden + net.hidden_bias, 0))
    return 1 / (1 + np.exp(-float((np.mean(hidden, axis=0) @ net.out + net.out_bias)[0])))


def test_quality_scores_are_those_of_plain_loops():
    net = quality_cnn.Network.new(np.random.default_rng(5))
    texts = ["", None, "a", "short text", "x" * 247, "x" * 248, "x" * 249, "long é " * 300, "".join(chr(33 + k * 7 % 90) for k in range(1500))]
    assert quality_cnn.scores(texts, net) == pytest.approx([plain_score(t, net) for t in texts], abs=1e-5)


@pytest.mark.parametrize("step", [2, 512])
def test_quality_gradient(monkeypatch, step):
    monkeypatch.setattr(quality_cnn, "STEP", step)
    rng = np.random.default_rng(3)
    net = quality_cnn.Network.new(rng)
    texts = ["".join(map(chr, rng.integers(32, 127, n))) for n in (20, 700, 400)]
    labels = np.array([1, 0, 1], np.float32)

    def loss():
        p = np.array([plain_score(t, net) for t in texts])
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    gradients = quality_cnn._learn_batch(net, [quality_cnn._spaced(t.encode()) for t in texts], labels)
    for w, g in zip(net.weights(), gradients, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-5)


# ---- byte pair encoding ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["a  b", "a \n b", " ", "  ", "\t x", "x ", "x  ", "it's  we'll", "<|endoftext|>", "日本 語🙂 é", " a   b", "a b   c", "1234 567", "...  !!\n\n\n ", "a" * 5000, " " * 1000 + "x"]


def expected(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("block", [200, 16_000_000])
def test_bpe_matches_the_library(spark, docs, odd, vocabulary, library, block):
    hard = spark.createDataFrame([(k, t) for k, t in enumerate(HARD)], "doc_id long, text string")
    for frame in (hard, odd, docs.where("doc_id % 4 = 0")):
        found = bpe.digests(bpe.decode(bpe.encode(frame, vocabulary, block), vocabulary)).collect()
        want = [(r["doc_id"], *expected(r["text"], library)) for r in frame.select("doc_id", "text").collect()]
        assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_merges_are_the_library_s(library, vocabulary):
    rng = np.random.default_rng(2)
    ranks = bpe._load(vocabulary).ranks
    words = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in range(1, 40)] + [b"aaaaaaaaaaaaa", b"a" * 3000, b"abababababababab" * 9, "tokenisierungsverfahren".encode(), "日本語テキスト".encode()]
    words += ["".join(rng.choice(list("etaoin shrdlu"), 30)).encode() for _ in range(200)]
    assert [bpe.merged(w, ranks) for w in words] == [library._encode_single_piece(w) for w in words]


def test_equal_blocks_are_apart(spark, vocabulary):
    """Blocks of equal rows have names of their own, so none of them meet in one group."""
    rows = spark.createDataFrame([(1, "the same words again and again")] * 400, "doc_id long, text string").repartition(1)
    found = bpe.digests(bpe.decode(bpe.encode(rows, vocabulary, 300), vocabulary)).groupBy("doc_id", "n_tokens").count().collect()
    assert len(found) == 1 and found[0]["count"] == 400


def test_bpe_empty(empty, vocabulary):
    assert bpe.digests(bpe.decode(bpe.encode(empty, vocabulary), vocabulary)).collect() == []


# ---- nearest neighbours ----------------------------------------------------------------------------------------------


def brute(rows, queries, k):
    out = []
    for q_id, q in queries:
        scored = sorted(((-float(np.dot(np.array(q, np.float64), np.array(v, np.float64))), v_id) for v_id, v in rows if v_id != q_id and len(v) == len(q)))[:k]
        out += [(q_id, rank, v_id, -s) for rank, (s, v_id) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("shard_rows", [150, 10_000])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[300:350] = x[7]
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("own"))
    found = sorted(map(tuple, vptree.nearest(frame, frame.where("vec_id % 20 = 0"), 20, 1.0, shard_rows).collect()))
    want = sorted(brute(rows, [r for r in rows if r[0] % 20 == 0], 20))
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in found], [r[3] for r in want])


def test_recall_of_the_default(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    found = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(frame, frame.where("vec_id % 20 = 0")).collect()}
    want = {(q, v) for q, _, v, _ in brute(rows, [r for r in rows if r[0] % 20 == 0], 20)}
    assert len(found & want) / len(want) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, vptree.nearest(frame, frame, 20).collect()))
    assert found == [(0, 1, 8, 1.0), (0, 2, 7, 0.5), (7, 1, 0, 0.5), (7, 2, 8, 0.5), (8, 1, 0, 1.0), (8, 2, 7, 0.5)]
    assert vptree.nearest(frame.limit(0), frame.limit(0)).collect() == []


def test_repeated_rows_leave_room_for_other_ids(spark):
    """One row 100 times and 20 other ids of an equal vector: all 20 are the nearest of each other and of the repeated id."""
    rows = [(7, [1.0, 2.0])] * 100 + [(k, [1.0, 2.0]) for k in range(10, 30)] + [(50, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for q, rank, v, score in vptree.nearest(frame, frame, 20).collect():
        found.setdefault(q, {})[rank] = v, score
    ids = [7, *range(10, 30)]
    for q in ids:
        others = [i for i in ids if i != q]
        assert found[q] == {k + 1: (v, 5.0) for k, v in enumerate(others)}
    assert found[50] == {k + 1: (v, 1.5) for k, v in enumerate(ids[:20])}


def test_neighbours_tied_and_repeated(spark):
    """A hundred tied points and 50 repeats of one row: ties go to the smaller id, repeats count once."""
    rows = [(k, [1.0, k / 2000]) for k in range(1, 400)] + [(1000 + k, [1.0, 5.0]) for k in range(100)] + [(7, [1.0, 7 / 2000])] * 50 + [(20, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(20, [1.0, 0.0]), (500, [0.0, 1.0])], "vec_id long, embedding array<float>")
    for shard_rows in (16_384, 60):
        found = vptree.nearest(frame, queries, 20, 1.0, shard_rows).orderBy("query_id", "rank").collect()
        assert [r["vec_id"] for r in found if r["query_id"] == 20] == [*range(1, 20), 21]
        assert [r["vec_id"] for r in found if r["query_id"] == 500] == [*range(1000, 1020)]
    copies = spark.createDataFrame([(1, [1.0, 0.0])] * 50 + [(2, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    found = vptree.nearest(copies, copies.where("vec_id = 20"), 20, 1.0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("shard_rows", [16_384, 100])
def test_factor_one_is_exact_over_shards(spark, shard_rows):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(k, (centres[k % 12] + rng.normal(size=6)).tolist()) for k in range(900)] + [(2000, [0.0] * 6), (2001, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = frame.where("vec_id % 20 = 0")
    usable = [(i, v) for i, v in rows if any(v)]
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in vptree.nearest(frame, queries, 20, 1.0, shard_rows).collect()}
    want = {(q, rank): v for q, rank, v, _ in brute(usable, [(i, v) for i, v in usable if i % 20 == 0], 20)}
    assert found == want

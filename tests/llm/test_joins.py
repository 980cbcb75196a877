"""Line dedup and near-duplicate detection against brute force."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from voxlake.llm import components, line_dedup, near_dedup, shingles

WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def corpus(seed: int, groups: int, size: int, words: int, edits: int) -> list[tuple[int, str]]:
    """Groups of texts that differ in a few words, on two lines each."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        for _ in range(size):
            own = base[:]
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: words // 2]) + "\n" + " ".join(own[words // 2 :])))
    return rows


# ---- lines -----------------------------------------------------------------------------------------------------------


def expected_lines(rows, t=0.8):
    lines = [(d, k, frozenset(WORDS.findall(x))) for d, text in sorted(rows) for k, x in enumerate((text or "").split("\n"))]
    places = defaultdict(list)
    for p, (_, _, s) in enumerate(lines):
        if s:
            places[s].append(p)
    sets = list(places)
    linked = defaultdict(set)
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if len(a & b) / len(a | b) >= t - 1e-12:
                linked[a].add(b)
                linked[b].add(a)
    out = {d: [d, d, len((text or "").split("\n")), 0, []] for d, text in rows}
    for p, (d, k, s) in enumerate(lines):
        if not s:
            continue
        first = min(places[x][0] for x in (s, *linked[s]))
        row = out[d]
        row[3] += len(linked[s])
        if first < p:
            row[4].append(k)
        if linked[s] or len(places[s]) > 1:
            row[1] = min(row[1], lines[first][0])
    return sorted((d, c, n, links, sorted(gone)) for d, c, n, links, gone in out.values())


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_lines(spark, t):
    rows = corpus(5, 12, 8, 24, 5) + [(1000, "a b"), (1001, "b a"), (1002, "a b c d e"), (1003, "a b c d f"), (1004, None), (1005, "\n \n"), (1006, "solo"), (1007, "solo\nsolo solo")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.matches(frame, t).collect())) == expected_lines(rows, t)


def test_lines_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 3)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.sample("abcdefghijkl", rng.randrange(1, 12)))) for k in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.matches(frame).collect())) == expected_lines(rows)


def test_lines_of_odd_rows(odd, empty):
    found = line_dedup.matches(odd).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in odd.collect())
    kept = line_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert all(r[c] == "own" for r in kept.collect() for c in CLASHING)
    assert kept.where("doc_id = 9").first()["text"] == "" and kept.where("doc_id = 2 AND text IS NOT NULL").count() == 0
    assert line_dedup.matches(empty).collect() == [] and line_dedup.deduplicate(empty).collect() == []


def expected_classes(rows, t=0.8):
    """The least id of each component of documents, by brute force over pairs of lines."""
    lines = [(d, s) for d, text in rows for x in (text or "").split("\n") if (s := frozenset(WORDS.findall(x)))]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(lines):
        for e, b in lines[:i]:
            if len(a & b) / len(a | b) >= t - 1e-12:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d, _ in rows}


def test_line_classes_of_chains(spark):
    """Documents 1 and 3 don't match, 2 matches both; 4 and 5 hold one line each of 6; 7 stands alone."""
    w = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(w[:10])), (2, " ".join(w[1:11])), (3, " ".join(w[2:12])), (4, "p q r"), (5, "s t u"), (6, "s t u\nr q p"), (7, "x y"), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"], r["source"]) for r in line_dedup.classes(frame).collect()}
    assert found == {1: (1, 1, 1), 2: (1, 2, 1), 3: (1, 1, 2), 4: (4, 0, 4), 5: (4, 0, 5), 6: (4, 0, 4), 7: (7, 0, 7), 8: (8, 0, 8)}


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_line_classes(spark, t):
    rows = corpus(5, 12, 8, 24, 5) + [(1000, "a b"), (1001, "b a"), (1004, None), (1006, "solo"), (1007, "solo\nsolo solo")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.classes(frame, t).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected_classes(rows, t)
    columns = ["doc_id", "source", "n_lines", "n_links", "removed"]
    assert sorted(tuple(r[c] for c in columns) for r in found) == expected_lines(rows, t)


def test_line_classes_of_odd_rows(odd, empty):
    found = line_dedup.classes(odd).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in odd.collect())
    assert {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] in (1, 9)} == {1: 1, 9: 1}
    assert line_dedup.classes(empty).collect() == []


def test_entries_of_frequent_words_and_others(spark, monkeypatch):
    """Entries of words over the bound meet as rows, all others in blocks, in more buckets than one."""
    monkeypatch.setattr(line_dedup, "BUFFER", 4)
    monkeypatch.setattr(line_dedup, "BUCKET", 100)
    rows = corpus(6, 8, 7, 24, 4) + [(1000, "a b"), (1001, "b a"), (1002, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.classes(frame).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected_classes(rows)


def entries_of_words(rng, words, count):
    """Entries in the order of (word, size): of each word a large kind of sets that look alike, and others."""
    rows = []
    for w in range(words):
        base = rng.integers(-(2**62), 2**62)
        for _ in range(count):
            alike = rng.random() < 0.8
            rows.append((w, int(rng.integers(40, 45)), int(rng.integers(0, 3)) * 4 + int(rng.integers(1, 4)), int(rng.integers(0, words * count)), int(base if alike else rng.integers(-(2**62), 2**62))))
    columns = [np.array(c) for c in zip(*sorted(set(rows)), strict=True)]
    return [columns[0], columns[1].astype(np.int32), columns[2].astype(np.int32), columns[3], columns[4]]


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("slab", [50, 700, 1 << 21])
def test_candidates_of_slabs(monkeypatch, joined, slab):
    """Any slabs tell the same sets, or components, as all pairs do."""
    monkeypatch.setattr(line_dedup, "SLAB", slab)
    word, size, place, name, sketch = columns = entries_of_words(np.random.default_rng(3), 4, 60)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(word)), np.arange(len(word)), indexing="ij"))
    keep = (word[a] == word[b]) & (place[a] & 2 > 0) & (place[b] & 1 > 0) & (size[b] <= size[a]) & (size[b] >= np.ceil(0.8 * size[a] - 1e-9))
    a, b = line_dedup._likely(a[keep], b[keep], size.astype(int), place.astype(int), sketch.view(np.uint64)[:, None], name, 0.8)
    found = [r for batch in line_dedup._found(0.8, joined)(columns) for r in batch.to_pylist()]
    if not joined:
        assert sorted(r["name"] for r in found) == sorted(set(name[a].tolist()) | set(name[b].tolist()))
        return
    group = lambda pairs: {x: frozenset(c) for c in groups_of(pairs) for x in c}
    assert group([(r["a"], r["b"]) for r in found]) == group(zip(name[a].tolist(), name[b].tolist(), strict=True))


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    found = {}
    for x in root:
        found.setdefault(find(x), set()).add(x)
    return found.values()


@pytest.mark.parametrize("joined", [False, True])
def test_candidates_of_a_large_group_are_never_held_together(monkeypatch, joined):
    """Of 6,000 sets that all look alike, of 18 million pairs, a slab exists at once."""
    monkeypatch.setattr(line_dedup, "SLAB", 1 << 16)
    n = 6000
    columns = [np.zeros(n, np.int64), np.full(n, 40, np.int32), np.full(n, 3, np.int32), np.arange(n), np.zeros(n, np.int64)]
    tracemalloc.start()
    try:
        found = sum(batch.num_rows for batch in line_dedup._found(0.8, joined)(columns))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == n - joined and peak < 32e6


def test_entries_of_one_word_are_cut(spark, monkeypatch):
    """No word keeps more entries than two blocks have, and each given entry meets each asking one once."""
    monkeypatch.setattr(line_dedup, "BUFFER", 50)
    rows = [(7, 10, 4 * (k % 2) + 1 + k % 3, k, 0) for k in range(400)] + [(8, 10, 3, k, 0) for k in range(20)]
    frame = spark.createDataFrame(rows, "word long, size int, place int, name long, s0 long")
    large = spark.createDataFrame([(7, 400)], "word long, n long")
    out = [tuple(r) for r in line_dedup._cut(frame, large).collect()]
    assert max(Counter(r[0] for r in out).values()) <= 160
    meet = lambda rows: Counter((a[3], b[3], a[2] >> 2, b[2] >> 2) for a in rows for b in rows if a[0] == b[0] and a[2] & 2 and b[2] & 1)
    assert meet(out) == meet(rows)


def test_entries_travel_in_blocks():
    """A block for each bucket, which holds each entry of its words once; null and empty lists give none."""
    entry = lambda *pairs: np.array(list(pairs), line_dedup._ENTRY).tobytes()
    lists = pa.array([entry((5, 3), (6, 7)), b"", entry((7, 1)), entry((5, 2))], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([4, 9, 4, 5], pa.int32()), pa.array([10, 11, 12, 13]), lists, pa.array([1, 2, 3, 4])], ["size", "name", "entries", "s0"])
    for rows, keep in ((batch, [0, 1, 2, 3]), (batch.slice(2), [2, 3])):
        found = {}
        for block in line_dedup._blocks(2, 1)(iter([rows])):
            for bucket, data in zip(*(c.to_pylist() for c in block.columns), strict=True):
                assert bucket not in found
                found[bucket] = [(int(r["word"]), int(r["name"]), r["sketch"].tolist(), int(r["size"]), int(r["place"])) for r in np.frombuffer(data, line_dedup._record(1))]
        every = [(5, 10, [1], 4, 3), (6, 10, [1], 4, 7), (7, 12, [3], 4, 1), (5, 13, [4], 5, 2)]
        want = [x for x in every if x[1] - 10 in keep]
        assert found == {b: own for b in (0, 1) if (own := [x for x in want if x[0] % 2 == b])}


def test_short_hashes():
    texts = ["", "a", "b", "ab", "ba", "\0", "\0\0", "12345678", "12345678\0", "123456789", "912345678", "x" * 64, "x" * 65, "y" + "x" * 64, "x" * 64 + "y", "é", "日本語" * 50]
    whole = shingles.short_hashes(pa.array(texts))
    assert len(set(whole.tolist())) == len(texts)
    assert shingles.short_hashes(pa.array(["q", *texts]).slice(1)).tolist() == whole.tolist()
    assert shingles.short_hashes(pa.array([], pa.string())).tolist() == []


def test_deduplicate_removes_what_matches_names(spark):
    rows = corpus(9, 5, 5, 20, 3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {d: set(g) for d, _, _, _, g in expected_lines(rows)}
    want = sorted((d, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[d])) for d, text in rows)
    assert sorted(map(tuple, line_dedup.deduplicate(frame).collect())) == want


def test_string_hashes():
    texts = ["", "a", "b", "ab", "ba", "x" * 64, "x" * 65, "y" + "x" * 64, "x" * 64 + "y", "é", "日本語" * 50]
    whole = shingles.string_hashes(pa.array(texts))
    assert len(set(whole.tolist())) == len(texts)
    assert (shingles.string_hashes(pa.array(texts).slice(3, 5)) == whole[3:8]).all()


# ---- near copies -----------------------------------------------------------------------------------------------------


def weighted_sets(rows, spark):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return near_dedup.weighted(pa.array([t for _, t in rows]), near_dedup.idf(frame))


def test_near_classes_hold_all_close_pairs_and_no_far_ones(spark):
    rows = corpus(3, 25, 6, 120, 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.classes(frame).collect()}
    sets = weighted_sets(rows, spark)
    n = len(rows)
    sim = {(i, j): near_dedup.weighted_jaccard(sets[i], sets[j]) for i in range(n) for j in range(i) if i // 6 == j // 6}
    close = [p for p, s in sim.items() if s >= 0.9]
    assert len(close) > 100 and sum(found[i][0] == found[j][0] for i, j in close) / len(close) > 0.99
    # a class is joined by verified links only: the components of pairs that are similar
    parent = [*range(n)]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), s in sim.items():
        if s >= 0.8 - 1e-9:
            parent[root(i)] = root(j)
    assert all(root(i) == root(found[i][0]) for i in range(n))
    sizes = Counter(c for c, _ in found.values())
    assert all(size == sizes[c] for c, size in found.values())


def plain_similarities(rows):
    """Weighted Jaccard similarities of all pairs, from words and dictionaries alone."""
    sets = []
    for _, text in rows:
        words = WORDS.findall((text or "").lower())
        parts = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        sets.append(Counter(parts))
    held = Counter(x for s in sets for x in s)
    factor = {x: 0.75 + 0.25 * math.log(len(rows) / n) / math.log(len(rows)) for x, n in held.items()}
    weighed = [{x: n * factor[x] for x, n in s.items()} for s in sets]
    out = {}
    for i, a in enumerate(weighed):
        for j, b in enumerate(weighed[:i]):
            shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
            if shared:
                out[i, j] = shared / (sum(a.values()) + sum(b.values()) - shared)
    return out


def test_near_classes_of_all_pairs(spark):
    """Over all pairs of documents, with a passage that many share: none that is clearly similar is missed, and every class is
    joined by similar pairs."""
    rng = random.Random(17)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = corpus(21, 12, 6, 100, 4) + corpus(22, 4, 10, 60, 2)
    rows += [(0, " ".join(f"q{rng.randrange(10**6)}" for _ in range(50)) + " " + passage) for _ in range(40)]
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame).collect()}
    similar = plain_similarities(rows)
    close = [p for p, x in similar.items() if x >= 0.88]
    assert len(close) > 30 and all(found[i] == found[j] for i, j in close)
    linked = [p for p, x in similar.items() if x >= 0.8 - 1e-6]
    assert sum(found[i] == found[j] for i, j in linked) >= 0.95 * len(linked)
    parent = [*range(len(rows))]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    assert all(root(i) == root(c) for i, c in found.items())


@pytest.mark.parametrize("block", [(7, 300), (4096, 1 << 20)])
def test_document_frequencies_are_exact(spark, monkeypatch, block):
    """More distinct shingles than 2^21: hashed counters of a fixed number gave shingles of one document many."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block[0])
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block[1])
    rows = corpus(3, 8, 6, 120, 2) + [(48, None), (49, " "), (50, "x"), (50, "x"), (51, "x y")]
    if block[0] > 7:
        rows += [(100 + k, " ".join(f"u{k}_{i}" for i in range(30_000))) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, number = near_dedup.frequencies(frame)
    assert number == len(rows)
    sets = [h.tolist() for h, _ in shingles.shingles(pa.array([t for _, t in rows], pa.string()), near_dedup.WIDTH)]
    count = Counter(h for s in sets for h in s)
    want = {(d, t): [count[h] for h in s] for (d, t), s in zip(rows, sets, strict=True) if any(count[h] > 1 for h in s)}
    got = near_dedup._keyed(frame, "doc_id", "text").distinct().join(found, ["m1", "m2"]).collect()
    assert {(r["doc_id"], r["text"]): near_dedup._unpack(bytes(r["frequency"]), np.int32).tolist() for r in got} == want
    assert len(got) == len(want) == found.count()


def test_near_hot_group(spark):
    """Thousands of copies with one edit each stay one class."""
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(base[: k % 140] + [f"e{k}"] + base[k % 140 :])) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert near_dedup.classes(frame).select("class_id", "class_size").distinct().collect() == [(0, 1500)]


def test_near_odd_rows(odd, empty):
    found = near_dedup.classes(odd).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in odd.collect())
    by_id = {(r["doc_id"]): r["class_id"] for r in found if r["doc_id"] in (9, 5, 7)}
    assert by_id == {9: 1, 5: 5, 7: 7}
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and all(r[c] == "own" for r in kept.collect() for c in CLASHING)
    # two texts under id 1, one without an id, those without shingles, and 5, 6, 7, 8
    assert kept.count() == 8
    assert near_dedup.classes(empty).collect() == [] and near_dedup.deduplicate(empty).collect() == []


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    sampler = near_dedup._Sampler()
    a = np.sort(rng.integers(0, 1 << 63, 400, np.uint64))
    b = np.sort(np.concatenate([a[:360], rng.integers(0, 1 << 63, 40, np.uint64)]))
    hits = total = 0
    for _ in range(40):
        shift = rng.integers(0, 1 << 63, 1, np.uint64)
        x, y = np.sort(a + shift), np.sort(b + shift)
        bands = [sampler.bands(s, np.ones(len(s), np.float32), np.array([len(s)]))[0] for s in (x, y)]
        hits += (bands[0] == bands[1]).sum()
        total += near_dedup.BANDS
    assert hits / total == pytest.approx((360 / 440) ** near_dedup.ROWS, abs=0.08)


def test_components(spark):
    rng = random.Random(0)
    edges = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(0, 300) if k % 50 != 49] + [("hub", f"x{k}") for k in range(400)]
    rng.shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "a string, b string"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got["x7"] == "hub" and got["n0049"] == "n0000" and got["n0050"] == "n0050" and len(set(got.values())) == 7
    assert found.groupBy("node").count().where(F.col("count") > 1).count() == 0


@pytest.mark.parametrize("step", [None, 10])
def test_contraction_lets_go_of_its_edges(monkeypatch, step):
    """Where components are found, the texts of the edges that they come from are gone."""
    seen, alive = [], []

    def roots(*args):
        alive.append(sum(x() is not None for x in seen[:-1]))
        return own(*args)

    def batches():
        for k in range(40):
            batch = pa.RecordBatch.from_pydict({"a": [f"n{k + 1}", f"n{k + 100}"], "b": [f"n{k}", f"m{k}"]})
            seen.append(weakref.ref(batch))
            yield batch
            del batch

    own = components.roots
    monkeypatch.setattr(components, "roots", roots)
    found = [(r["a"], r["b"]) for batch in components._contract(step)(batches()) for r in batch.to_pylist()]
    assert alive and not any(alive)
    pairs = [(f"n{k + 1}", f"n{k}") for k in range(40)] + [(f"n{k + 100}", f"m{k}") for k in range(40)]
    assert set(map(frozenset, groups_of(found))) == set(map(frozenset, groups_of(pairs)))
    assert all(a > b for a, b in found)

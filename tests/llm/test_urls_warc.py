"""URL filters and WARC archives."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from voxlake.llm import url_cascade, warc

URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/", "https://www.example.com/en/x?q=1", "https://a.www.example.com/en/#f", "http://badexample.com/en/",
    "http://x.net/es/a", "http://x.net/fr/", "http://x.net/fr", "http://net/es/", "http://com/", "http://com", "http://a..com/", "http://x.org/en/", "http://user@example.com/en/", "http://example.com?/en/",
    "ftp://example.com:80/en/", "http://ÄB.com/", "http://" + "a." * 500 + "com/" + "p/" * 5000, "http://x.net/es/a", "://example.com/en/y",
]


def judged(url, rules=url_cascade.RULES, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail.split("?")[0].split("#")[0]
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, default))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, "http://x.net/es/a"), (3, "http://x.net/es/a")]
    return spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "_keys", "h1", "key", "payload", "_same")})


@pytest.mark.parametrize("max_bytes", [1 << 20, 8])
def test_verdicts(pages, max_bytes):
    found = url_cascade.verdicts(pages, max_bytes=max_bytes).collect()
    expected = [(r["page_id"], *judged(r["url"])) for r in pages.collect()]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("max_bytes", [1 << 20, 64])
def test_long_lists_are_cut_into_ranges(spark, max_bytes):
    """120 rules of either kind: filters of at most 64 bytes hold a part of the keys at a time."""
    rules = [(f"h{k}.org/" + "p" * (k % 3), "block" if k % 2 else "allow") for k in range(240)] + [("org/", "block")]
    urls = [(k, f"http://{'www.' * (k % 2)}h{k}.org/{'p' * (k % 4)}/x") for k in range(300)]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    found = url_cascade.verdicts(frame, rules, max_bytes=max_bytes).collect()
    assert sorted(map(tuple, found)) == sorted((k, *judged(u, rules)) for k, u in urls)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key LIKE '%7'").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    levels = url_cascade.build(listed, universe)
    assert len(levels) > 1
    rows = universe.select("key", *[h.alias(f"h{k}") for k, h in enumerate(url_cascade.hashes(F.col("key")))]).toPandas()
    assert (url_cascade.member(levels, rows["h0"].to_numpy(), rows["h1"].to_numpy()) == rows["key"].str.endswith("7").to_numpy()).all()


def test_no_rules_and_empty(spark, pages):
    assert {r["verdict"] for r in url_cascade.verdicts(pages, []).collect()} == {"allow"}
    assert url_cascade.verdicts(pages.limit(0)).collect() == []


HTML = ["<p>same</p>", "<p>same</p>", None, "", "<b>é \U0001f642</b>", "x" * 300_000, "<p>same</p>", "only"]


@pytest.fixture(scope="module")
def captures(spark):
    rows = [(10, "http://b.org/1", HTML[0]), (3, "http://a.org/2", HTML[1]), (4, "http://a.org/2", HTML[2]), (5, None, HTML[3]), (6, "http://a.org/q?x=1#f", HTML[4]), (7, "no scheme", HTML[5]), (None, "http://b.org/1", HTML[6]), (8, "http://b.org/\n 1", HTML[7])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("key", "payload", "_same", "refers_to", "_first")})


def sha(payload: str | None) -> str:
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


@pytest.mark.parametrize(("min_bytes", "filter_bytes"), [(0, 1 << 20), (0, 0), (12, 1 << 20)])
def test_archive_round_trip(spark, captures, tmp_path, min_bytes, filter_bytes):
    store = warc.write(captures, tmp_path.as_uri(), min_bytes, filter_bytes)
    found = sorted(map(tuple, warc.summary(warc.read(store)).collect()), key=str)
    rows = [(r["page_id"], r["html"]) for r in captures.collect()]
    first = {}
    for page, html in rows:
        if len((html or "").encode()) >= min_bytes and page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    expected = []
    for page, html in rows:
        other = first.get(html or "")
        revisit = other is not None and page != other
        expected.append((page, len((html or "").encode()), sha(html), "revisit" if revisit else "response", other if revisit else None))
    assert found == sorted(expected, key=str)


def test_one_response_for_each_payload(spark, tmp_path):
    """Rows that repeat id, url and payload, or only id and payload: one is the response, record ids are all different."""
    rows = [(3, "http://a.org/", "<p>x</p>")] * 3 + [(3, "http://b.org/", "<p>x</p>"), (5, "http://a.org/", "<p>x</p>"), (3, "http://a.org/", "other"), (None, None, "none"), (None, None, "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.archive_and_read(spark, pages, tmp_path.as_uri()).collect()
    counts = {}
    for r in found:
        key = (r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload_bytes"])
        counts[key] = counts.get(key, 0) + 1
    x, other, none = sha("<p>x</p>"), sha("other"), sha("none")
    assert counts == {(3, x, "response", None, 8): 1, (3, x, "revisit", 3, 8): 3, (5, x, "revisit", 3, 8): 1, (3, other, "response", None, 5): 1, (None, none, "response", None, 4): 1, (None, none, "revisit", None, 4): 1}
    names = [line for f in tmp_path.glob("*.warc.gz") for line in gzip.decompress(f.read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(names) == len(set(names)) == len(rows)


def test_query_reads_back_through_the_index(spark, captures, tmp_path):
    store = warc.write(captures, tmp_path.as_uri())
    by_url = sorted(map(tuple, warc.summary(warc.look_up(store, captures.select("url"), nulls=True)).collect()), key=str)
    assert by_url == sorted(map(tuple, warc.summary(warc.read(store)).collect()), key=str)


def test_look_up_reads_by_range(spark, captures, tmp_path):
    store = warc.write(captures, tmp_path.as_uri())
    asked = spark.createDataFrame([("http://a.org/2",), ("http://b.org/1",), ("http://b.org/\n 1",), ("http://absent.org/",), (None,)], "url string")
    found = warc.look_up(store, asked).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in found) == [("10", "revisit"), ("3", "response"), ("4", "response"), ("8", "response"), ("None", "revisit")]
    assert next(bytes(r["payload"]) for r in found if r["page_id"] == 3) == b"<p>same</p>"


def test_look_up_in_archives_that_overlap(spark, tmp_path):
    """Keys with one beginning of 128 characters are dealt by page_id, so archives overlap: all captures are found."""
    base = "http://a.org/" + "p" * 200
    rows = [(k, f"{base}/{k * 40 + 1 if k < 20 else k * 5:03d}", f"<p>{k}</p>") for k in range(80)] + [(100, "http://z.org/", "<p>last</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = warc.write(pages, tmp_path.as_uri())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ranges = sorted((r["first"], r["last"]) for r in store.archives.collect())
    assert len(ranges) > 1 and any(a[1] > b[1] for a, b in zip(ranges, ranges[1:], strict=False))
    found = warc.look_up(store, pages.select("url")).collect()
    assert sorted(r["page_id"] for r in found) == sorted(k for k, _, _ in rows)


def test_key_order_within_archives(spark, captures, tmp_path):
    store = warc.write(captures, tmp_path.as_uri())
    assert [r[0] for r in captures.where("page_id = 6").select(warc.url_key(F.col("url"))).collect()] == ["org,a)/q?x=1"]
    assert all(r["first"] <= r["last"] for r in store.archives.collect())


def test_no_pages(spark, captures, tmp_path):
    assert warc.archive_and_read(spark, captures.limit(0), tmp_path.as_uri()).collect() == []

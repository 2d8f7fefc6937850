"""Operators on pages and vectors: brute force, round trips, awkward rows."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wattline.llm import topk, warc


def test_archives_round_trip(spark):
    page = "<html>" + "x" * 200 + "</html>"
    rows = [(4, "http://a/\r\nb c", page, "r"), (2, None, page, "r"), (2, None, page, "r"), (9, "u", page, None), (None, "u", page, "r"), (1, "u", None, "r"),
            (3, "u", "", "r"), (5, "u", "short", "r"), (6, "u", "short", "r"), (7, "u", "é" * 50, "r"), (8, "u", "é" * 50, "r"),
            (10, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n" * 400, "r"), (None, "u", "z" * 100, "r"), (None, "v", "z" * 100, "r"), (11, "u", "q" * 3_000_000, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    first = {}
    for p, _, h, _ in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    want = Counter()
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        refers = first.get(h) if len(raw) >= 100 and first.get(h) != p else None
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert Counter(tuple(r) for r in warc.archive_round_trip(pages).collect()) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_normaliser_rewrites_each_record_as_a_member(spark, tmp_path):
    records = [warc.record(i, "u", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), None) for i in range(40)]
    whole = tmp_path / "a.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(records[:25])) + gzip.compress(b"".join(records[25:])))  # two streams, one file
    files = spark.createDataFrame([(str(whole),)], "path string")
    index = sorted(warc.normalise(files, str(tmp_path)).collect(), key=lambda r: r["offset"])
    raw = (tmp_path / "a.members.warc.gz").read_bytes()
    assert [gzip.decompress(raw[r["offset"]:r["offset"] + r["length"]]) for r in index] == records
    assert gzip.decompress(raw) == b"".join(records)
    lines = (tmp_path / "a.members.warc.gz.idx").read_text().splitlines()
    assert [line.split("\t") for line in lines] == [[str(r["offset"]), str(r["length"]), r["record_id"], r["record_type"]] for r in index]
    rewritten = spark.createDataFrame([(r["path"],) for r in index[:1]], "path string")
    assert sorted(map(tuple, warc.read_index(rewritten, str(tmp_path)).collect())) == sorted(map(tuple, index))


def test_broken_stream_is_an_error():
    raw = gzip.compress(warc.record(1, "u", b"x" * 50, "d", None)[:-20])
    with pytest.raises(ValueError):
        list(warc.records_of(iter([raw])))


def _exact(rows, k):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        qv = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("sizes", [(8192, 1024), (40, 2)])
def test_top_k(spark, sizes):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1 + i % 9) for _ in range(8)], "x") for i in range(400)]
    same = [0.5] * 8
    rows += [(1000 + i, same, "x") for i in range(300)]  # a common vector: ties go to the smaller id
    rows += [(2000, None, "x"), (2001, [1.0, None] + [0.0] * 6, "x"), (2002, [float("nan")] + [0.0] * 7, "x"), (2003, [float("inf")] * 8, "x"), (2100, [0.0] * 8, "x"),
             (2004, [3.0, 4.0], "x"), (2200, [1.0, 1.0], "x"), (2005, [], "x"), (None, same, "x"), (2200, [1.0, 1.0], "x"), (7, rows[7][1], "x"), (2300, [-1e6] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket string").repartition(4)
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, bucket_rows=sizes[0], query_rows=sizes[1]).collect()
    assert sorted(tuple(r) for r in got) == sorted(_exact([r[:2] for r in rows], 10))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_buckets_are_pruned():
    import pandas as pd

    rnd = np.random.default_rng(4)
    unit = rnd.normal(size=(3000, 4))
    v = (unit / np.linalg.norm(unit, axis=1, keepdims=True) * rnd.choice([1000, 300, 50], size=(3000, 1))).astype(np.int64)
    bucket = pd.DataFrame({"vec_id": np.arange(3000), "v": list(v), "n2": (v * v).sum(1)})
    q = v[0]
    scores = np.sort(v[1:] @ q)
    for least, most in ((scores[-10], 700), (scores[-300], 2200), (None, 2999)):
        queries = pd.DataFrame({"query_id": [0], "q": [q], "n2": [int(q @ q)], "least": [least]})
        stats = {}
        found = topk.search_bucket(queries, bucket, 10, stats)
        assert [s for _, _, s in found] == scores[::-1][:10].tolist()
        assert stats["verified"] <= most

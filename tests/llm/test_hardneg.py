"""Hard negatives against plain scores, on awkward rows and in small blocks."""

import random
from collections import Counter

import numpy as np
import pytest

from wattline.llm import hardneg


def brute(rows, anchor_ids, positives=5, negatives=3):
    good = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for a in sorted({i for i, _, _ in good if i in anchor_ids}):
        _, label, v = min(g for g in good if g[0] == a)
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if i != a and len(w) == len(v)]
        best = sorted((s, i) for s, i, other in scored if other == label)[:positives]
        for nth, (p, pid) in enumerate(best):
            fit = sorted((s, i) for s, i, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            for rank, (s, i) in enumerate(fit):
                out[a, pid, rank + 1, i, -p, -s, nth + 1] += 1
    return out


def some_rows(seed, n, dim=11, labels=3):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(labels), [rnd.gauss(0, 0.4) for _ in range(dim)]) for i in range(n)]


def awkward_rows():
    rows = some_rows(1, 160)
    same = [0.3] * 11
    rows += [(1000 + i, 1, same) for i in range(150)] + [(3000 + i, 2, same) for i in range(5)]  # a common vector: ties go to the smaller id
    rows += [(2000, None, same), (2001, 0, None), (2002, 0, [None] + same[1:]), (2003, 1, [float("nan")] * 11), (2004, 1, [float("inf")] * 11),
             (None, 1, same), (2005, 1, []), (2050, 1, []), (2006, 1, [0.5, 0.25]), (2100, 2, [0.5, 0.5]), (2101, 1, [0.5, 0.25]), (2102, 2, [0.5, 0.5]),
             (7, 0, rows[7][2]), (50, 2, rows[50][2]), (50, 2, rows[50][2]), (2150, 2, [0.0] * 11), (2200, 5, same), (2250, 1, [-x for x in same]),
             (2300, 1, [40000.0] * 11), (2301, 1, [39000.0] * 11), (2302, 2, [30000.0] * 11), (2303, 2, [1e-9] * 11), (2304, -4, [-1e-9] * 11)]
    return rows


@pytest.mark.parametrize("sizes", [(4096, 256), (50, 3)])
def test_awkward_rows(spark, sizes):
    rows = awkward_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, label int, embedding array<float>, block int, bits string, pos int").repartition(4)
    anchors = df.where("vec_id % 50 = 0")
    got = hardneg.mine(df, anchors, block_rows=sizes[0], anchor_rows=sizes[1]).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, {i for i, _, _ in rows if i is not None and i % 50 == 0})
    assert hardneg.mine(df.limit(0), anchors).count() == 0 == hardneg.mine(df, anchors.limit(0)).count()


def test_labels_are_moved_on(spark):
    rows = some_rows(2, 400, 16, 10)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    want = Counter(k[:6] for k in brute(moved, set(range(0, 400, 50))).elements())
    out = hardneg.mine_noisy(df)
    assert Counter(tuple(r) for r in out.collect()) == want
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("most", [1, 100, 10**6, 2**40, 2**61])
def test_products_are_exact(most):
    rnd = random.Random(most)
    v = np.array([[rnd.randrange(-most, most) for _ in range(13)] for _ in range(40)], np.int64)
    q = np.array([[rnd.randrange(-most, most) for _ in range(13)] for _ in range(5)], np.int64)
    planes = max(map(hardneg.planes_of, v))
    bits = np.frombuffer(b"".join(hardneg.pack(x, planes) for x in v), np.uint8).reshape(40, planes, 2)
    kind = np.int64 if most < 2**28 else object
    got = hardneg.products(bits, planes, hardneg.subset_sums(q.astype(kind)))
    assert got.tolist() == [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in q] for x in v]


def test_a_width_of_its_own(spark):
    assert [hardneg.planes_of(np.array(v)) for v in ([0], [1], [-1], [-2], [127, -128], [128], [2**62])] == [1, 2, 1, 2, 8, 9, 64]
    assert hardneg.quantise([1e300, -1e300], 256).tolist() == [hardneg.MOST, -hardneg.MOST]

"""Hard-negative mining by Four-Russians scoring (operator 12).

A candidate's integer components are cut into bit planes (two's complement, as many as
the row needs), and every eight dimensions of a plane into one byte.  For an anchor and a
group of eight dimensions a table holds the sums of all 256 subsets of its components
there, so a byte indexes the group's share of a plane's product.  The shares of a plane
are added, shifted by the plane's place and added (the sign plane taken away) into the
full inner product; every score is exact.

Two passes over blocks of candidates: anchors meet the blocks that hold their own label
for their best positives, then all blocks of other labels for the negatives that lie in
the window of each positive's score.  Rows lie in blocks by (label, vec_id), so a block
has few labels, and a label or a vector that fills a third of the table fills many blocks.
Anchors come in blocks too; a task holds one block of each, and keeps no more than the
asked number of rows per anchor and window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, numbered

BLOCK_ROWS = 4096
ANCHOR_ROWS = 256
SLICE = 32  # anchors whose tables are looked up together
MOST = 1 << 62  # a component beyond it counts as it, a score beyond 2**63 - 1 as that
_PACKED = "vec_id long, label long, dim int, planes int, bits binary, q array<long>"
_POSITIVE = "anchor_id long, vec_id long, score long"
_NEGATIVE = "anchor_id long, positive_rank int, vec_id long, score long"


def quantise(values: list | np.ndarray, scale: int) -> np.ndarray | None:
    """floor(scale * x) of every component; None where one is null or not finite."""
    x = np.array([np.nan if c is None else c for c in values], np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def planes_of(v: np.ndarray) -> int:
    """The least number of bits that hold every component in two's complement."""
    return 1 + max([int(x if x >= 0 else ~x).bit_length() for x in (v.min(), v.max())]) if len(v) else 1


def pack(v: np.ndarray, planes: int) -> bytes:
    """The bit planes, lowest first; a plane is a byte for every eight dimensions, dimension 0 in its lowest bit."""
    bits = (v[None, :] >> np.arange(planes, dtype=np.int64)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of every eight components, by adding one component at a time."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    x = np.zeros((groups * 8, n), anchors.dtype)
    x[:dim] = anchors.T
    table = np.zeros((groups, 256, n), anchors.dtype)
    for g in range(groups):
        for i in range(8):
            table[g, 1 << i:2 << i] = table[g, :1 << i] + x[8 * g + i]
    return table


def products(bits: np.ndarray, planes: int, table: np.ndarray) -> np.ndarray:
    """(candidates, anchors): inner products from packed planes (candidates, planes, groups) and subset sums."""
    score = np.zeros((len(bits), table.shape[2]), table.dtype)
    for k in range(planes):
        share = np.zeros_like(score)
        for g in range(table.shape[0]):
            share += table[g][bits[:, k, g]]
        share *= 1 << k if table.dtype != object else int(1 << k)
        score = score - share if k == planes - 1 else score + share  # the last plane is the sign
    return score


def _scores(anchors: pd.DataFrame, block: pd.DataFrame):
    """(rows of anchors, rows of the block, scores): for every slice of anchors and the candidates of their dimension and width."""
    for dim in np.unique(anchors["dim"]):
        of_dim = np.flatnonzero(anchors["dim"] == dim)
        there = block["dim"].to_numpy() == dim
        for planes in np.unique(block["planes"].to_numpy()[there]):
            rows = np.flatnonzero(there & (block["planes"].to_numpy() == planes))
            bits = np.frombuffer(b"".join(block["bits"].iloc[rows]), np.uint8).reshape(len(rows), planes, -(-dim // 8))
            for lo in range(0, len(of_dim), SLICE):
                some = of_dim[lo:lo + SLICE]
                q = np.stack(anchors["q"].iloc[some].to_numpy()).reshape(len(some), dim)
                most = float(np.abs(q.astype(np.float64)).max(initial=0)) * 2.0 ** int(planes) * max(int(dim), 1)
                kind = np.int32 if most < 2.0 ** 31 else np.int64 if most < 2.0 ** 63 else object
                found = products(bits, int(planes), subset_sums(q.astype(kind)))
                if kind is object:
                    found = np.clip(found, 1 - (1 << 63), (1 << 63) - 1)
                yield some, rows, found.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        there = np.flatnonzero(score >= least)
        return there[np.lexsort((ids[there], -score[there]))][:k]
    return np.lexsort((ids, -score))[:k]


def best_positives(anchors: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per anchor, the k best other rows of its label in the block."""
    out, ids, labels = [], block["vec_id"].to_numpy(), block["label"].to_numpy()
    for some, rows, found in _scores(anchors, block):
        for j, a in enumerate(some):
            mine = (labels[rows] == anchors["label"].iloc[a]) & (ids[rows] != anchors["vec_id"].iloc[a])
            score, who = found[mine, j], ids[rows][mine]
            out += [(anchors["vec_id"].iloc[a], who[i], score[i]) for i in _best(score, who, k)]
    return pd.DataFrame(out, columns=["anchor_id", "vec_id", "score"]).astype("int64")


def best_negatives(anchors: pd.DataFrame, block: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """Per anchor and positive, the k best rows of other labels with low * p <= 100 * score <= high * p."""
    out, ids, labels = [], block["vec_id"].to_numpy(), block["label"].to_numpy()
    for some, rows, found in _scores(anchors, block):
        for j, a in enumerate(some):
            other = (labels[rows] != anchors["label"].iloc[a]) & (ids[rows] != anchors["vec_id"].iloc[a])
            score, who = found[other, j], ids[rows][other]
            for nth, p in enumerate(anchors["positives"].iloc[a]):
                floor, ceiling = -(-low * int(p) // 100), high * int(p) // 100  # whole numbers: 100 * s >= low * p
                fit = np.flatnonzero((score >= floor) & (score <= ceiling))
                out += [(anchors["vec_id"].iloc[a], nth + 1, who[fit[i]], score[fit[i]]) for i in _best(score[fit], who[fit], k)]
    return pd.DataFrame(out, columns=["anchor_id", "positive_rank", "vec_id", "score"]).astype({c: "int64" for c in ("anchor_id", "vec_id", "score")} | {"positive_rank": "int32"})


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, dim, planes, bits and the whole components ``q``; rows that take no part are left out."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("planes", pa.int32()), ("bits", pa.binary()),
                        ("q", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for i, label, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                v = quantise(values, scale)
                if v is not None:
                    planes = planes_of(v)
                    rows.append((i, label, len(v), planes, pack(v, planes), v))
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, _PACKED)


def in_blocks(keep: Scratch, name: str, rows: DataFrame, size: int) -> DataFrame:
    """``rows`` in written blocks of ``size`` by (label, vec_id)."""
    placed = numbered(keep, f"{name}-placed", rows, ["label", "vec_id", "bits"])
    return keep.table(name, placed.withColumn("block", F.floor(F.col("pos") / size).cast("int")).drop("pos", "n"))


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    ``vectors`` and ``anchors``: vec_id, label, embedding.  An anchor's positives are its
    ``positives`` best other rows of its label; for each come the ``negatives`` best rows
    of other labels whose score is ``low`` to ``high`` per cent of the positive's.  Scores
    are inner products of floor(scale * x); ties go to the smaller vec_id.  A positive of
    negative score has an empty window.

    Rows with a null id, label or vector, or a null or non-finite component, take no part;
    vectors of another dimension than an anchor's do not meet it; a repeated row counts as
    often as it occurs (a positive that occurs twice has two ranks), a repeated anchor id
    stands for its smallest label and vector; rows of an anchor's id are not its partners;
    empty tables give no rows; other columns are not read.
    """
    keep = Scratch(vectors.sparkSession, "hardneg")
    cand = in_blocks(keep, "candidates", packed(vectors, scale).drop("q"), block_rows)
    once = packed(anchors, scale).groupBy("vec_id").agg(F.min(F.struct("label", "q", "dim", "bits")).alias("s")).select("vec_id", "s.*")
    anch = in_blocks(keep, "anchors", once, anchor_rows)
    anch = anch.withColumnRenamed("block", "ablock").drop("bits")
    # which labels lie in which blocks: no more rows than labels and blocks together
    of_cand = keep.table("labels", cand.select("label", "block").distinct())
    of_anch = keep.table("anchor_labels", anch.select("label", "ablock").distinct())
    same = keep.table("same", of_anch.join(of_cand, "label").select("ablock", "block").distinct())
    last = cand.agg(F.max("block")).first()[0] or 0
    every = of_anch.groupBy("ablock").agg(F.min("label").alias("one"), F.max("label").alias("most")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    single = of_cand.groupBy("block").agg(F.min("label").alias("c_one"), F.max("label").alias("c_most"))
    # a pair of blocks of one and the same label holds no negatives
    other = keep.table("other", every.join(single, "block").where(
        (F.col("one") != F.col("most")) | (F.col("c_one") != F.col("c_most")) | (F.col("one") != F.col("c_one"))).select("ablock", "block"))

    def meet(a: DataFrame, pairs: DataFrame, search, schema: str) -> DataFrame:
        """``search`` on every pair of blocks, a group of its own."""
        keys = ["ablock", "block"]
        left, right = a.join(pairs, "ablock"), cand.join(pairs, "block")

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            return search(x, y) if len(x) and len(y) else search(x[:0], y[:0])

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = keep.table("positives", meet(anch, same, lambda x, y: best_positives(x, y, positives), _POSITIVE)
                      .withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives))
    windows = best.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "score"))), lambda s: s["score"]).alias("positives"))
    asked = keep.table("asked", anch.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("score"), "vec_id")
    found = (meet(asked, other, lambda x, y: best_negatives(x, y, negatives, low, high), _NEGATIVE)
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
    given = best.select("anchor_id", "positive_rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["anchor_id", "positive_rank"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), "positive_rank")


def mine_noisy(vectors: DataFrame) -> DataFrame:
    """``mine`` on labels of which those of ids divisible by 7 are moved on by one of ten; anchors are the ids divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    v = vectors.select("vec_id", label.alias("label"), "embedding")
    return mine(v, v.where(F.col("vec_id") % 50 == 0)).drop("positive_rank")


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

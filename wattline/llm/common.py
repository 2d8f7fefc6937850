"""Shared pieces of the training-data operators: columns, scratch tables, hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns; any other column is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SALTS = 256  # equal rows may lie in as many ranges


def numbered(keep: Scratch, name: str, df: DataFrame, order: list[str], *by: str, add: str | None = None) -> DataFrame:
    """``df`` with ``pos``, the place by ``order`` among the rows of equal ``by`` (none of them null), and ``n``, their number.

    The rows are dealt out by ranges of (``by``, ``order``) and written; a row's place is its
    number in its range plus the counts of the ranges before, so no group is one task.
    With ``add`` there is also ``before``, the sum of that column over the rows before.
    """
    sort = [*by, *order, "_salt"]
    spread = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    placed = keep.table(name, spread.repartitionByRange(parts(df.sparkSession), *sort).sortWithinPartitions(*sort)
                        .withColumn("_row", F.monotonically_increasing_id()).drop("_salt"))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    value, more = F.lit(0) if add is None else F.coalesce(F.col(add), F.lit(0)), [] if add is None else ["before"]
    if add is not None:
        own = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(own), F.lit(0)))
    per = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy(*by)))
    per = per.withColumn("_upto", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    out = placed.join(per, [*by, "_part"]).withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first"))
    return (out if add is None else out.withColumn("before", F.col("_upto") + F.col("_inside"))).select(*df.columns, "pos", "n", *more)


class Scratch:
    """Written tables of one run, in a folder of its own under ``spark.checkpoint.dir``.

    They cut lineage and outlive a lost executor; ``drop`` removes the ones no longer read,
    and lets Spark clean up the shuffles that went into them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()  # Spark removes the shuffle files of plans that neither Python nor the JVM holds any longer
        jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the 0 .. n-1, modulo 2**64, from a table that a worker keeps and doubles."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), np.uint64(base), np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


class SpanHash:
    """Hashes of byte spans of one buffer from prefix sums; equal spans get equal hashes anywhere."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers(_BASE, n), out=self.prefix[1:])
        self.inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` bytes, by start."""
        n = max(len(self.prefix) - size, 0)
        return mix((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]) if n else np.zeros(0, np.uint64)


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 buffer."""
    edge = np.diff(np.concatenate([[0], (~is_space(data)).view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all values, each followed by a line feed, and the start of each value (plus the end)."""
    lens = np.fromiter((len(v) + 1 for v in values), np.int64, len(values))
    starts = np.concatenate([[0], np.cumsum(lens)])
    return np.frombuffer(b"\n".join(values) + b"\n" if values else b"", np.uint8), starts


def text_chunks(column: pa.Array, limit: int = 4 << 20):
    """(from, to, values): the UTF-8 bytes (null: empty) of consecutive rows, about ``limit`` of them in all.

    Only one chunk's values are Python objects at a time; one longer value stands alone.
    """
    raw = column.cast(pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(raw):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to, [v or b"" for v in raw.slice(at, to - at).to_pylist()]
        at = to

"""b-bit MinHash near-duplicate detection (operator 6).

Documents with the same shingle set form a class, and only classes are compared.
Each class has PERMUTATIONS minima; bands of them give candidate buckets, and the low
BITS of each after a finaliser, packed, give an estimate of the similarity: m matching
positions of k estimate (m / k - c) / (1 - c), c = 2 ** -BITS being the chance of an
accidental match.  Without the finaliser the low bits of a minimum are those of its
shingle, and two shingles would match by accident in all positions or in none.
Candidates whose estimate is not far below the limit are verified on full sets.

No bucket is expanded into its pairs.  Each first meets its leader only, the member
that shares most bucket places overall, which for a group of near copies is their
common origin.  Verified links give components; a bucket whose members are then one
component needs nothing more, as further links could change nothing.  In the others
every member outside the leader's component is compared with every member of another
component, so no link between components is lost and nothing is capped.  Groups whose
members are a little too unlike would then give very many pairs to verify, so here the
estimate is finer, from one bit each of FINE minima.

At a similarity of 0.8 a pair shares none of 32 bands of 4 with a chance of 5e-8; its
estimate falls below ESTIMATE_FROM with one of 4e-6, the fine one below FINE_FROM with
one of 1e-6, whatever the size of the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, SpanHash, fold_ascii, joined, mix, text_chunks, texts, word_spans

BANDS, ROWS, BITS = 32, 4, 4
PERMUTATIONS = BANDS * ROWS
ESTIMATE_FROM = 0.62
FINE, FINE_FROM = 2048, 0.735
CHUNK = 1 << 19  # bytes of text hashed at once; tables of powers of twice that size stay with a worker
SIGNED = "doc_id long, text_key long, n_shingles long, cls binary, sig array<long>, bands array<long>"
_MULTIPLY = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ORDER = mix(np.arange(5001, 5065, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(values: list[bytes], size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of value ``i`` are ``hashes[offsets[i]:offsets[i + 1]]``.

    Words are parted by the six ASCII white-space characters and compared without
    ASCII case; fewer words than ``size`` are one shingle, none gives an empty set.
    """
    data, starts = joined(values)
    data = fold_ascii(data)
    ws, we = word_spans(data)
    n = np.zeros(len(values) + 1, np.int64)
    if not len(ws):
        return np.zeros(0, np.uint64), n
    h = SpanHash(data)(ws, we)
    owner = np.searchsorted(starts, ws, "right") - 1
    words = np.bincount(owner, minlength=len(values))
    first = np.cumsum(words) - words
    full = np.flatnonzero(np.arange(len(ws)) - first[owner] <= words[owner] - size)
    code = np.zeros(len(full), np.uint64)
    for j in range(size):
        code += h[full + j] * _ORDER[j]
    who = owner[full]
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            there = words[short] > j
            few[there] += h[first[short][there] + j] * _ORDER[j]
        code = np.concatenate([code, few + words[short].astype(np.uint64) * _ORDER[size]])
        who = np.concatenate([who, short])
    code = mix(code)
    order = np.lexsort((code, who))
    code, who = code[order], who[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (who[1:] != who[:-1])
    n[1:] = np.cumsum(np.bincount(who[new], minlength=len(values)))
    return code[new], n


def class_of(hashes: np.ndarray) -> bytes | None:
    """The name of a shingle set; None for the empty one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def minima(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, PERMUTATIONS) minima of the non-empty sets."""
    start = offsets[:-1][np.diff(offsets) > 0]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), PERMUTATIONS), np.uint32)
    for i in range(PERMUTATIONS if len(start) else 0):
        out[:, i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], start)
    return out


def scrambled(least: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser (murmur3): the low bits of multiply-and-add minima depend on the low bits of the shingle alone."""
    x = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS of the scrambled minima, 64 // BITS to a word."""
    per = 64 // BITS
    low = (scrambled(least) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.zeros((len(least), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures, from bit counts."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):  # any of the four bits set sets the lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    wrong = sum((differing(F.col(a)[i], F.col(b)[i]) for i in range(PERMUTATIONS * BITS // 64)), F.lit(0))
    c = 2.0 ** -BITS
    return (1 - wrong / F.lit(float(PERMUTATIONS)) - c) / (1 - c)


def _mark(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def signed(docs: DataFrame, size: int = 4) -> DataFrame:
    """Set size, class, packed signature and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, values in text_chunks(b.column(1), CHUNK):
                h, at = shingle_sets(values, size)
                n = np.diff(at)
                least = minima(h, at)
                sig, keys = iter(packed(least).tolist()), iter(band_keys(least).tolist())
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo:hi], pa.int64()), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array([class_of(h[at[i]:at[i + 1]]) for i in range(hi - lo)], pa.binary()),
                    pa.array([next(sig) if k else None for k in n], pa.list_(pa.int64())),
                    pa.array([next(keys) if k else None for k in n], pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "cls", "sig", "bands"])

    return texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, size: int = 4) -> DataFrame:
    """(cls, shingles): the sorted shingle hashes of every document that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, values in text_chunks(b.column(0), CHUNK):
                h, at = shingle_sets(values, size)
                sets = [h[at[i]:at[i + 1]] for i in range(hi - lo) if at[i + 1] > at[i]]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls binary, shingles binary").dropDuplicates(["cls"])


def fine_signatures(sets: DataFrame) -> DataFrame:
    """(cls, fine): the lowest bits of FINE further scrambled minima of every set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply = (mix(np.arange(20_001, FINE + 20_001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        add = (mix(np.arange(40_001, FINE + 40_001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        for b in batches:
            for lo, hi, sets_ in text_chunks(b.column(1), 1 << 20):
                values = [np.frombuffer(v, np.uint64) for v in sets_]
                x = (np.concatenate(values) >> np.uint64(32)).astype(np.uint32)
                start = np.cumsum([0, *map(len, values)])[:-1]
                bits = np.empty((hi - lo, FINE), np.uint8)
                for i in range(FINE):
                    bits[:, i] = scrambled(np.minimum.reduceat(x * multiply[i] + add[i], start)) & np.uint32(1)
                packed_ = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(packed_.tolist(), pa.list_(pa.int64()))], names=["cls", "fine"])

    return sets.select("cls", "shingles").mapInArrow(run, "cls binary, fine array<long>")


def fine_estimate(a: str, b: str) -> Column:
    """As ``estimate``, of one-bit signatures: half of what does not match agrees by chance.

    A loop over the words: written out, they make a method too long for the JVM to compile.
    """
    wrong = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return 1 - 2 * wrong / F.lit(float(FINE))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """(node, root): the least node reachable, by alternating large-star and small-star until only stars are left.

    Every step is a minimum per node (combined map-side) and a join; only a count reaches the driver.
    """
    def lower(e: DataFrame, both_ways: bool) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else e
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = ends.join(least, "u")
        if both_ways:  # larger neighbours go to the least
            out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # the node and its smaller neighbours go to the least
            out = j.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
                                             F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        return out.where(F.col("a") != F.col("b")).distinct()

    step = 0
    e = keep.table(f"{name}-0", edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    while True:
        step += 1
        new = keep.table(f"{name}-{step}", lower(lower(e, True), False))
        keep.drop(f"{name}-{step - 1}")
        e = new
        # stars, which another step would not change: every larger end has one edge, and is no smaller end
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(F.col("up") + F.col("down") > F.greatest(F.lit(1), "down")).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of ``docs``.

    Links join documents with 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest doc_id reachable and kept says that it is the
    document's own.  A document without words has an empty set and is linked with
    nothing.  Null ids stay null and are never a component's id unless it has no other;
    repeated rows share their set, so their component; an empty table gives no rows.
    """
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id of every row of ``docs``."""
    spark = docs.sparkSession
    keep = Scratch(spark, "neardup")
    sig = keep.table("signed", signed(docs, size))
    classes = keep.table("classes", sig.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("sig", "bands")).alias("s")).select("cls", "first", "s.sig", "s.bands"))
    places = classes.select("cls", F.explode("bands").alias("key"))
    sizes = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = keep.table("members", places.join(sizes, "key"))
    score = members.groupBy("cls").agg(F.sum("n").alias("score"))
    leaders = keep.table("leaders", members.join(score, "cls").groupBy("key").agg(F.max(F.struct("score", "cls")).alias("l")).select("key", F.col("l.cls").alias("leader")))
    sigs = classes.select("cls", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb"))
        return pairs.join(a, "a").join(b, "b").where(estimate("sa", "sb") >= ESTIMATE_FROM).select("a", "b")

    first = members.join(leaders, "key").where(F.col("cls") != F.col("leader")).select(
        F.col("cls").alias("a"), F.col("leader").alias("b")).distinct()
    stars = keep.table("stars", likely(first))
    # full sets of the classes in shared buckets, from the texts of their first documents
    needed = members.select("cls").distinct().join(classes.select("cls", "first"), "cls").select(F.col("first").alias("doc_id")).distinct()
    sets = keep.table("sets", full_sets(texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(0))).join(
        needed.select(F.coalesce("doc_id", F.lit(0)).alias("_key")).distinct(), "_key", "left_semi"), size))
    links = keep.table("links", verified(stars, sets, percent))
    roots = components(links, keep, "first")

    at = keep.table("at", members.select("key", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", F.coalesce("root", "cls").alias("root")))
    open_ = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    open_members = keep.table("open", at.join(open_, "key"))
    few = open_members.select("cls").distinct()
    fine = fine_signatures(sets.join(few, "cls", "left_semi")).join(classes.select("cls", F.transform("bands", _mark).alias("marks")), "cls")
    rest = keep.table("rest", open_members.join(leaders, "key").join(fine, "cls"))
    main = rest.where(F.col("cls") == F.col("leader")).select("key", F.col("root").alias("main"))
    other = rest.where(F.col("cls") != F.col("leader"))
    outside = other.join(main, "key").where(F.col("root") != F.col("main")).select(
        "key", F.col("cls").alias("a"), F.col("root").alias("ra"), F.col("fine").alias("fa"), F.col("marks").alias("ma"))
    other = other.select("key", F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("fine").alias("fb"), F.col("marks").alias("mb"))
    # a pair that shares several buckets is compared in the first of them
    earlier = F.array_position("ma", _mark(F.col("l.key"))).cast("int") - 1
    apart = ((F.col("l.key") == F.col("r.key")) & (F.col("ra") != F.col("rb"))
             & ~F.arrays_overlap(F.slice("ma", F.lit(1), earlier), F.slice("mb", F.lit(1), earlier))
             & (fine_estimate("fa", "fb") >= FINE_FROM))  # last: most pairs of a large group share an earlier bucket
    later = outside.alias("l").join(other.alias("r"), apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = keep.table("more", verified(later, sets, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more), keep, "second")
    keep.drop("members", "leaders", "stars", "sets", "at", "open", "rest", "more")

    ids = classes.select("cls", "first").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = ids.groupBy("root").agg(F.min("first").alias("component"))
    named = ids.join(least, "root").select("cls", "component")
    out = sig.select("doc_id", "text_key", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``docs`` with one document of every component, the one that names it; of its repeated rows, one."""
    kept = grouped(docs, size, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_kept")).distinct()
    fields = ["`" + c.replace("`", "``") + "`" for c in docs.columns]  # in a struct, so that no column's name can clash
    rows = docs.select(F.struct(*[F.col(f).alias(f"c{i}") for i, f in enumerate(fields)]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_kept"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Substring dedup by bucket-pointer refinement (operator 5).

A byte goes if some string of LENGTH bytes that covers it also starts elsewhere.  The
suffixes that could start such a string are sorted into ever finer buckets:

1. q-gram buckets.  Every string of LENGTH bytes is put into the buckets of its least
   GRAM-byte pieces under two hash orders.  Only those pieces are counted over the corpus
   (two in about LENGTH / 2 bytes); a string in a bucket of one piece is unique.
2. Refinement by later bucket identifiers.  The strings left are cut into segments at
   places named by their own bytes, so copies are cut alike.  A segment's name is the
   hash of its whole extent, from its first string's start to its last one's end; a
   name that occurs twice settles all its strings.  A segment's pointer is the bucket
   of the bytes after the cut at its end as far as all its strings reach: where no other
   segment has that pointer, all its strings are unique.
3. Only where some segments with a shared pointer are not settled do strings go on: those
   of the segments not settled, and of one segment for each settled name, are named one
   by one, and equal names are equal strings.

A key of a passage that very many documents hold (a piece, a name) is not shuffled: keys of
more than a COMMON-th of the rows, at most COMMON of them, are sent to the rows instead, and
of a settled segment only the first one asks for its pointer.

Names are 128 bits, computed from prefix sums where the text is; names stand for the
ranks of a suffix array, so that a refinement round needs no sort of all positions.
Texts with equal bytes are taken once and settled as a whole.  Counts are summed per
key map-side; no bucket is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, SpanHash, joined, mix, text_chunks

LENGTH, GRAM = 400, 32
CUT, CUT_BYTES, REACH = 24, 16, 256  # one place in CUT is a cut; a string looks for one within REACH
STEP = 32  # strings of a segment begin in the same STEP bytes before their cut
CHUNK = 1 << 19
COMMON = 4096
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by doubling."""
    n, have = len(x), 1
    if n < size:
        return x[:0]
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n - size + 1], x[size - have:][:n - size + 1]) if have < size else x


class Batch:
    """Texts side by side, and which places start a string of ``length`` bytes of one text."""

    def __init__(self, values: list[bytes], length: int):
        self.length, self.values = length, values
        self.data, self.starts = joined(values)
        self.hash = SpanHash(self.data)
        size = np.diff(self.starts) - 1
        room = np.zeros(len(self.data) + 1, np.int64)
        whole = size >= length
        np.add.at(room, self.starts[:-1][whole], 1)
        np.add.at(room, self.starts[:-1][whole] + size[whole] - length + 1, -1)
        n = max(len(self.data) - length + 1, 0)
        self.valid = np.cumsum(room)[:n] > 0
        self.grams = [self.hash.every(min(GRAM, length))]
        self.grams.append(mix(self.grams[0] + np.uint64(1)))
        self.least = [sliding_least(g, length - min(GRAM, length) + 1) for g in self.grams]  # of each string

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def anchors(values: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per value, the buckets of its strings; a piece that occurs more than once in the value is given twice."""
    b = Batch(values, length)
    valid = np.flatnonzero(b.valid)
    out: list[list] = [[] for _ in values]
    for grams, least in zip(b.grams, b.least):
        change = np.ones(len(valid), bool)
        change[1:] = (least[valid][1:] != least[valid][:-1]) | (valid[1:] != valid[:-1] + 1)
        at = valid[change]
        cut = np.searchsorted(at, b.starts)
        for i in range(len(values)):
            v = np.unique(least[at[cut[i]:cut[i + 1]]])
            if len(v):
                own = grams[b.starts[i]:b.starts[i + 1] - 1 - min(GRAM, length) + 1]
                own = np.sort(own[own <= v[-1]])
                n = np.searchsorted(own, v, "right") - np.searchsorted(own, v)
                out[i] += [v, v[n > 1]]
    return [np.concatenate(v) if v else np.zeros(0, np.uint64) for v in out]


def segments(b: Batch, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, after, upto): the strings starting in first..last belong together; the bytes after..upto point on.

    ``shared``: the (sorted) buckets that hold more than one piece; other strings are unique and in no segment.
    """
    at = np.flatnonzero(b.valid)
    for least_of in b.least:
        least = least_of[at]
        change = np.ones(len(at), bool)
        change[1:] = least[1:] != least[:-1]
        run = np.flatnonzero(change)
        at = at[np.repeat(np.isin(least[run], shared), np.diff(np.append(run, len(at))))]
    if not len(at):
        return (at,) * 4
    place = np.flatnonzero((b.hash.every(CUT_BYTES) >> np.uint64(20)) % np.uint64(CUT) == 0)
    after = np.append(place, np.iinfo(np.int64).max)[np.searchsorted(place, at, "right")]
    reach = min(REACH, b.length - CUT_BYTES)
    near = after - at <= reach
    step = np.where(near, (after - at - 1) // STEP, -1)
    after = np.where(near, after, at)  # no cut near: a string by itself, its pointer is all of it
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (after[1:] != after[:-1]) | (step[1:] != step[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], after[first], (after + b.length - np.minimum(STEP * (step + 1), reach))[first]


def names(b: Batch, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each span of bytes, its length being part of the name."""
    size = (end - start).astype(np.uint64)
    second = SpanHash(b.data, seed=2)
    return (b.hash(start, end) + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), second(start, end).view(np.int64)


def spans_of(starts: np.ndarray, length: int) -> np.ndarray:
    """[from, to, from, to ...]: the maximal runs of bytes covered by the strings at (sorted) ``starts``."""
    if not len(starts):
        return starts
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + length
    first = np.flatnonzero(new)
    return np.stack([starts[first], starts[np.append(first[1:], len(starts)) - 1] + length], axis=1).ravel()


def kept_bytes(value: bytes, spans: list[int] | None) -> bytes:
    """What is left of a text without its spans; without all of it where ``spans`` is null."""
    if spans is None:
        return b""
    at = [0, *spans, len(value)]
    return b"".join(value[at[i]:at[i + 1]] for i in range(0, len(at), 2))


def common_keys(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counts`` (a row per key, ``n`` rows each) parted into keys of more than a COMMON-th of all counted rows, so at most COMMON, and others."""
    hot = F.col("n") > F.lit((counts.agg(F.sum("n")).first()[0] or 0) // COMMON)
    return counts.where(hot).drop("n"), counts.where(~hot).drop("n")


def meet(rows: DataFrame, counts: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` joined (inner or left_semi) to ``counts``: common keys are broadcast, the others joined by key, the same way at any size."""
    common, rare = common_keys(counts)
    common = F.broadcast(common)
    return rows.join(common, keys, how).unionByName(rows.join(common, keys, "left_anti").join(rare.hint("merge"), keys, how))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def repeated_strings(docs: DataFrame, length: int = LENGTH, carried: Column | None = None) -> DataFrame:
    """doc_id, text, ``spans`` and ``carried`` of ``docs``: the bytes covered by strings that also start elsewhere.

    ``spans`` is [from, to, from, to ...], null where that is the whole text (which another
    row has too), and empty where no string occurs twice; ``carried`` goes along as it is.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "suffix")
    d = docs.select("doc_id", "text", (F.lit(None).cast("int") if carried is None else carried).alias("carried")).withColumn("_k", _key())

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_k", pa.int64()), ("t", pa.binary()), ("grams", pa.list_(pa.int64()))])
        for batch in batches:
            ks = batch.column(0).to_pylist()
            for lo, hi, values in text_chunks(batch.column(1), CHUNK):
                yield _arrow([(k, hashlib.blake2b(v, digest_size=16).digest(), g.view(np.int64))
                              for k, v, g in zip(ks[lo:hi], values, anchors(values, length)) if len(g)], schema)

    info = keep.table("info", d.select("_k", "text").mapInArrow(first_pass, "_k long, t binary, grams array<long>"))
    same = keep.table("same", info.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("one")).where(F.col("n") > 1))
    # one of the rows with equal texts stands for all
    state = keep.table("state", meet(info.select("_k", "t"), same, ["t"], "inner").select(
        "_k", F.when(F.col("_k") == F.col("one"), 1).otherwise(2).alias("copy")).distinct())
    once = info.select("_k", "grams").join(state.where("copy = 2"), "_k", "left_anti").select("_k", F.explode("grams").alias("g"))
    shared = keep.table("shared", once.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    flags = meet(once.distinct(), shared, ["g"], "left_semi").groupBy("_k").agg(F.collect_list("g").alias("grams"))
    marks = keep.table("marks", flags.join(state, "_k", "full_outer"))

    whole = d.join(marks, "_k", "left")
    fate = F.when(F.col("copy") == 2, F.lit(2)).when(F.col("grams").isNotNull(), F.lit(1)).when(F.col("copy") == 1, F.lit(2)).otherwise(F.lit(0))
    whole = keep.table("whole", whole.select("doc_id", "text", "carried", "_k", "grams", F.coalesce("copy", F.lit(0)).alias("copy"), fate.alias("fate")))
    open_docs = whole.where("fate = 1").select("_k", "text", "grams")
    keep.drop("info", "same", "state", "shared", "marks")

    def pieces(batch: pa.RecordBatch):
        """(batch of texts, segments, their ordinals within their text, the texts' rows)."""
        for lo, hi, values in text_chunks(batch.column(1), CHUNK):
            b = Batch(values, length)
            flagged = batch.column(2).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            first, last, after, upto = segments(b, np.unique(flagged))
            who = b.owner(first)
            nth = np.arange(len(first)) - np.searchsorted(who, who)
            yield b, first, last, b.hash(after, upto), who, nth, lo

    def name_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy()
            for b, first, last, pointer, who, nth, lo in pieces(batch):
                h1, h2 = names(b, first, last + length)
                yield pa.RecordBatch.from_arrays([pa.array(ks[lo + who]), pa.array(nth.astype(np.int32)), pa.array(h1), pa.array(h2),
                                                  pa.array(pointer.view(np.int64))], names=["_k", "nth", "h1", "h2", "pointer"])

    seg = keep.table("segments", open_docs.mapInArrow(name_segments, "_k long, nth int, h1 long, h2 long, pointer long"))
    # a name that occurs twice, and its first segment, which alone asks for its pointer
    twice = keep.table("twice", seg.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_k", "nth", "pointer")).alias("one")).where(F.col("n") > 1))
    common, rare = common_keys(twice)
    common_names = [(r["h1"], r["h2"]) for r in common.select("h1", "h2").collect()]  # at most COMMON
    hot_names = np.array(sorted(common_names), np.int64).reshape(-1, 2)

    def hot_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's segments of common names as one row (or a few): no row per segment."""
        for batch in batches:
            h1, h2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = np.minimum(np.searchsorted(hot_names[:, 0], h1), len(hot_names) - 1)
            hit = np.flatnonzero((hot_names[at, 0] == h1) & (hot_names[at, 1] == h2))
            ks, nth = batch.column(0).to_numpy()[hit], batch.column(1).to_numpy()[hit]
            order = np.argsort(ks, kind="stable")
            ks, nth = ks[order], nth[order]
            first = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]])) if len(ks) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ks)).astype(np.int32)), pa.array(nth))
            yield pa.RecordBatch.from_arrays([pa.array(ks[first]), lists], names=["_k", "settled"])

    rest = keep.table("rest", seg.join(F.broadcast(common.select("h1", "h2")), ["h1", "h2"], "left_anti").join(
        rare.select("h1", "h2", F.lit(True).alias("settled")).hint("merge"), ["h1", "h2"], "left").select("_k", "nth", "pointer", F.coalesce("settled", F.lit(False)).alias("settled")))
    of_hot = keep.table("of_hot", seg.where(F.col("h1").isin([h for h, _ in common_names])).select("_k", "nth", "h1", "h2").mapInArrow(hot_lists, "_k long, settled array<int>"))
    asking = rest.where("not settled").unionByName(twice.select(F.col("one._k").alias("_k"), F.col("one.nth").alias("nth"), F.col("one.pointer").alias("pointer"), F.lit(True).alias("settled")))
    unsettled = keep.table("unsettled", asking.groupBy("pointer").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("settled"), 2).otherwise(1)).alias("of"), F.bool_and("settled").alias("all")).where(
        (F.col("of") > 1) & ~F.col("all")).select("pointer", "n"))
    asked = meet(asking, unsettled, ["pointer"], "left_semi").select("_k", "nth", F.when(F.col("settled"), "example").otherwise("open").alias("list"))
    told_of = rest.where("settled").select("_k", "nth", F.lit("settled").alias("list")).unionByName(asked).groupBy("_k").agg(
        *[F.collect_list(F.when(F.col("list") == n, F.col("nth"))).alias(n) for n in ("settled", "open", "example")])
    none = F.array().cast("array<int>")
    told_of = told_of.unionByName(of_hot.select("_k", "settled", none.alias("open"), none.alias("example")))
    of_doc = keep.table("of_doc", told_of.groupBy("_k").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in ("settled", "open", "example")]))
    keep.drop("segments", "twice", "rest", "of_hot", "unsettled")
    told = keep.table("told", open_docs.join(of_doc, "_k"))

    def chosen(batch: pa.RecordBatch, column: int):
        """Starts of the strings of the segments listed in a column."""
        for b, first, last, pointer, who, nth, lo in pieces(batch):
            part = batch.column(column).slice(lo, len(b.values))
            rows = np.repeat(np.arange(len(b.values)), np.diff(part.offsets.to_numpy()))
            want = np.searchsorted(who, rows) + part.flatten().to_numpy(zero_copy_only=False)
            n = (last - first + 1)[want]
            starts = np.repeat(first[want] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield b, np.repeat(rows, n), starts, lo

    def name_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy()
            for column, times in ((4, 1), (5, 2)):  # an example of a settled segment stands for two at least
                for b, rows, starts, lo in chosen(batch, column):
                    h1, h2 = names(b, starts, starts + length)
                    yield pa.RecordBatch.from_arrays([pa.array(ks[lo + rows]), pa.array((starts - b.starts[rows]).astype(np.int32)), pa.array(h1), pa.array(h2),
                                                      pa.array(np.full(len(rows), times, np.int32))], names=["_k", "at", "h1", "h2", "times"])

    named = told.where((F.size("open") > 0) | (F.size("example") > 0)).mapInArrow(name_strings, "_k long, at int, h1 long, h2 long, times int")
    strings = keep.table("strings", named)
    more = keep.table("more", strings.groupBy("h1", "h2").agg(F.sum("times").alias("n")).where(F.col("n") > 1))
    found = keep.table("found", meet(strings.where("times = 1"), more, ["h1", "h2"], "left_semi").groupBy("_k").agg(F.collect_list("at").alias("at")))
    keep.drop("strings", "more")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, found_at = batch.column(0), batch.column(4)
            for b, rows, starts, lo in chosen(batch, 3):
                spans = []
                cut = np.searchsorted(rows, np.arange(len(b.values) + 1)) if len(rows) else np.zeros(len(b.values) + 1, int)
                order = np.argsort(rows, kind="stable")
                for i in range(len(b.values)):
                    own = starts[order[cut[i]:cut[i + 1]]] - b.starts[i]
                    also = found_at[lo + i].values  # of this text alone: places of all a batch's texts would be very many Python numbers
                    spans.append(spans_of(np.unique(own if also is None else np.concatenate([own, also.to_numpy().astype(np.int64)])), length))
                yield pa.RecordBatch.from_arrays([ks.slice(lo, len(b.values)), pa.array(spans, pa.list_(pa.int64()))], names=["_k", "spans"])

    spans = keep.table("spans", told.join(found, "_k", "left").select("_k", "text", "grams", "settled", "at").mapInArrow(
        put_together, "_k long, spans array<long>").dropDuplicates(["_k"]))
    keep.drop("told", "of_doc", "found")
    none = F.array().cast("array<long>")
    some = whole.where("fate = 1").join(spans, "_k", "left").select(
        "doc_id", "text", "carried", F.when(F.col("copy") == 1, F.lit(None)).otherwise(F.coalesce("spans", none)).alias("spans"))
    rest = whole.where("fate != 1").select("doc_id", "text", "carried", F.when(F.col("fate") == 2, F.lit(None)).otherwise(none).alias("spans"))
    return some.unionByName(rest)


def cut_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` of rows with a last column of spans, what these cover cut from the text, in parts of about CHUNK bytes of text."""
    at = names.index("text")
    for b in batches:
        for lo, hi, values in text_chunks(b.column(at), CHUNK):
            part = b.slice(lo, hi - lo)
            cols = list(part.columns[:-1])
            kept = [kept_bytes(v, s).decode(errors="ignore") for v, s in zip(values, part.column(len(names)).to_pylist())]
            cols[at] = pa.array(kept, cols[at].type)
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array(list(map(len, kept)), cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the text left and its n_chars; a character that lost one of its bytes goes with it.

    Other columns, whatever their names, stay as they are.
    """
    names, schema = docs.columns, docs.schema
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    row = F.struct(*[F.col(q).alias(f"c{i}") for i, (c, q) in enumerate(zip(names, quoted)) if c != "text"])
    found = repeated_strings(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row.alias("row")), length, F.col("row"))

    return found.select(*["text" if c == "text" else F.col(f"carried.c{i}").alias(f"c{i}") for i, c in enumerate(names)], F.col("spans").alias("cut")).mapInArrow(
        lambda batches: cut_batches(batches, names), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Null text is empty; texts shorter than ``length`` bytes lose nothing; a repeated row
    is a document of its own, so both lose all their strings; a null doc_id stays null;
    an empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, spans = [], b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, hi, values in text_chunks(b.column(1)):
                for doc, value, s in zip(ids[lo:hi], values, spans[lo:hi]):
                    kept = kept_bytes(value, s)
                    rows.append((doc, len(value), len(value) - len(kept), 1 if s is None else len(s) // 2, hashlib.sha256(kept).hexdigest()))
            yield _arrow(rows, schema)

    return repeated_strings(d, length).select("doc_id", "text", "spans").mapInArrow(run, REMOVED)

"""Document fingerprints as invertible Bloom lookup sketches (operator 2).

A document is the multiset of its paragraph pieces: lines, cut further after
words chosen by their own hash, so that an edit touches only nearby pieces.
Each piece's 64-bit digest goes to one cell in each of three tables; a cell
holds a count, a digest sum and a check sum.  Cells of two documents subtract,
which leaves the pieces in which they differ, and peeling cells that hold one
digest recovers those.  Where a sketch is too small to peel, both sides are
sketched anew at four times the size, until the difference is recovered.
The likeness of two documents is their pieces in common over all pieces.

Documents are dealt out by ranges of doc_id, so a neighbour is in the same task;
a range's largest document is also sent to the range above it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import SpanHash, joined, mix, parts, text_chunks, texts, word_spans

TABLES = 3
CELLS = 24  # of a stored fingerprint
GROWTH = 4
MOST_CELLS_A_PIECE = 64  # beyond this size a pair's digests are compared as sets
OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, n_pieces long, edited_cells int, next_cells int")
_U32 = np.uint64(0xFFFFFFFF)


def piece_digests(values: list[bytes], cut: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(digests, offsets): value ``i`` has ``digests[offsets[i]:offsets[i + 1]]``, all different within a value.

    A piece ends at the end of a line and after a word whose hash is a multiple
    of ``cut``; white space is not part of a digest.  The n-th equal piece of a
    value has a digest of its own, so that repeated lines count.
    """
    data, starts = joined(values)
    ws, we = word_spans(data)
    offsets = np.zeros(len(values) + 1, np.int64)
    if not len(ws):
        return np.zeros(0, np.uint64), offsets
    h = SpanHash(data)(ws, we)
    lines = np.cumsum(data == 10)
    last = np.ones(len(ws), bool)
    last[:-1] = (lines[ws[1:]] != lines[ws[:-1]]) | (h[:-1] % np.uint64(cut) == 0)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    nth = np.arange(len(ws)) - np.repeat(first, np.diff(np.append(first, len(ws))))
    piece = mix(np.add.reduceat(h * mix(nth.astype(np.uint64) + np.uint64(7)), first))
    value = np.searchsorted(starts, ws[first], "right") - 1
    order = np.lexsort((piece, value))
    piece, value = piece[order], value[order]
    same = np.zeros(len(piece), bool)
    same[1:] = (piece[1:] == piece[:-1]) & (value[1:] == value[:-1])
    run = np.flatnonzero(~same)
    copy = np.arange(len(piece)) - np.repeat(run, np.diff(np.append(run, len(piece))))
    offsets[1:] = np.cumsum(np.bincount(value, minlength=len(values)))
    return mix(piece + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), offsets


def cell_places(digests: np.ndarray, cells: int) -> np.ndarray:
    """One cell of each table for every digest (a row per table)."""
    per = np.uint64(cells // TABLES)
    return np.stack([mix(digests ^ np.uint64(cells + 7919 * t)) % per + np.uint64(t) * per for t in range(TABLES)]).astype(np.int64)


def check_of(digests: np.ndarray) -> np.ndarray:
    return mix(digests + np.uint64(0xA5A5A5A5)) & _U32


def add_to(table, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray, cells: int) -> None:
    """Add (or, with sign -1, subtract) digests in the flat cells of their owners."""
    count, total, check = table
    s = sign.astype(np.uint64)  # -1 wraps round: all sums are modulo 2**64
    for place in cell_places(digests, cells):
        at = owner * cells + place
        np.add.at(count, at, sign)
        np.add.at(total, at, digests * s)
        np.add.at(check, at, check_of(digests) * s)


def empty_table(owners: int, cells: int):
    n = owners * cells
    return np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)


def sketches(digests: np.ndarray, offsets: np.ndarray, cells: int = CELLS) -> list[str]:
    """The stored form: per cell count (4 bytes), digest sum (8), check sum (4), in base 64."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    count, total, check = table = empty_table(n, cells)
    add_to(table, owner, digests, np.ones(len(digests), np.int64), cells)
    raw = np.empty(n * cells, np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u4")]))
    raw["count"], raw["sum"], raw["check"] = count, total, check & _U32
    raw = raw.reshape(n, cells)
    return [base64.b64encode(raw[i].tobytes()).decode() for i in range(n)]


def peel(owner: np.ndarray, digests: np.ndarray, sign: np.ndarray, pairs: int, cells: int):
    """Recover the digests in which each pair differs from its subtracted cells.

    Returns, per pair, how many were recovered and whether nothing is left over.
    """
    count, total, check = table = empty_table(pairs, cells)
    add_to(table, owner, digests, sign, cells)
    found, look = np.zeros(pairs, np.int64), np.arange(pairs * cells)
    for _ in range(len(digests) + 1):  # each round but the last recovers one at least
        c = count[look]
        look = look[np.abs(c) == 1]
        s = count[look]
        key = total[look] * s.astype(np.uint64)
        pure = ((check[look] * s.astype(np.uint64)) & _U32) == check_of(key)
        look, s, key = look[pure], s[pure], key[pure]
        who = look // cells
        order = np.lexsort((key, who))  # a digest may be alone in several of its cells
        who, s, key = who[order], s[order], key[order]
        once = np.ones(len(who), bool)
        once[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
        who, s, key = who[once], s[once], key[once]
        if not len(who):
            break
        add_to(table, who, key, -s, cells)
        np.add.at(found, who, 1)
        look = np.unique((who * cells + cell_places(key, cells)).ravel())
    rest = (count != 0) | (total != 0)
    return found, ~rest.reshape(pairs, cells).any(axis=1)


def likeness(left, left_of: np.ndarray, right, right_of: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in common over all pieces (two empty documents: 1), and the cells that it took, for pairs of documents.

    ``left`` and ``right`` are (digests, offsets); pair k is value ``left_of[k]`` of
    the one against value ``right_of[k]`` of the other.
    """
    def take(side, of):
        digests, offsets = side
        n = (offsets[1:] - offsets[:-1])[of]
        at = np.repeat(offsets[:-1][of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return digests[at], np.repeat(np.arange(len(of)), n), n

    (a, ao, na), (b, bo, nb) = take(left, left_of), take(right, right_of)
    differ, used = np.zeros(len(left_of), np.int64), np.zeros(len(left_of), np.int32)
    todo = np.arange(len(left_of))
    while len(todo):
        place = np.full(len(left_of), -1)
        place[todo] = np.arange(len(todo))
        ka, kb = place[ao] >= 0, place[bo] >= 0
        who = np.concatenate([place[ao[ka]], place[bo[kb]]])
        sign = np.concatenate([np.ones(ka.sum(), np.int64), -np.ones(kb.sum(), np.int64)])
        got, done = peel(who, np.concatenate([a[ka], b[kb]]), sign, len(todo), cells)
        differ[todo[done]], used[todo[done]] = got[done], cells
        todo = todo[~done]
        cells *= GROWTH
        for k in todo[cells > MOST_CELLS_A_PIECE * (na + nb)[todo]]:  # digests that share all their cells
            differ[k], used[k] = len(np.setxor1d(a[ao == k], b[bo == k])), -1
        todo = todo[cells <= MOST_CELLS_A_PIECE * (na + nb)[todo]]
    both = na + nb
    return np.where(both > 0, (both - differ) / np.maximum(both + differ, 1), 1.0), used


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def _rows(docs: list[tuple], before: str) -> Iterator[tuple]:
    """Output rows of (doc_id, text) in rising order; the document below the first is ``before``."""
    for lo, hi, values in text_chunks(pa.array([t for _, t in docs], pa.large_string()), 2 << 20):
        below = [before if i == 0 else docs[i - 1][1] for i in range(lo, hi)]
        changed = [edited(t, n).encode() for (_, t), n in zip(docs[lo:hi], below)]
        own = piece_digests([below[0].encode()] + values)  # value i + 1 is document lo + i
        new = piece_digests(changed)
        n = hi - lo
        one, to = np.arange(1, n + 1), np.arange(n)
        near_e, cells_e = likeness(own, one, new, to)
        near_n, cells_n = likeness(own, one, own, to)
        prints, new_prints = sketches(*own)[1:], sketches(*new)
        for i in range(n):
            doc, text = docs[lo + i]
            yield (doc, len(text), hashlib.sha256(changed[i]).hexdigest(), prints[i], new_prints[i], float(near_e[i]),
                   float(near_n[i]), int(own[1][i + 2] - own[1][i + 1]), int(cells_e[i]), int(cells_n[i]))


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                    ("n_pieces", pa.int64()), ("edited_cells", pa.int32()), ("next_cells", pa.int32())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document is the one below in doc_id (a null doc_id is below all, equal
    ids go by their text's hash); below the last comes the first, and a lone document
    follows itself.  Null text is empty; an empty table gives no rows; repeated rows
    are documents of their own.
    """
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    d = texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # ranges of doc_id: n - 1 bounds and the largest document of each range reach the driver
    cut = d.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("at"), F.min("_key").alias("least")).first()
    bounds = sorted({b for b in cut["at"] or [] if b > cut["least"]})
    d = d.withColumn("_range", _range_of(F.col("_key"), bounds))
    largest = [r["k"] for r in d.groupBy("_range").agg(F.max("_key").alias("k")).collect()]
    ranges = len(bounds) + 1
    own, above = F.col("_range"), F.pmod(F.col("_range") + 1, F.lit(ranges))
    sent = d.withColumn("_to", F.explode(F.when(F.col("_key").isin(largest), F.array(F.struct(own.alias("r"), F.lit(1).alias("own")), F.struct(above.alias("r"), F.lit(0).alias("own"))))
                                         .otherwise(F.array(F.struct(own.alias("r"), F.lit(1).alias("own"))))))
    dealt = sent.repartitionById(ranges, F.col("_to.r").cast("int")).sortWithinPartitions(
        "_to.r", "_to.own", "_key", F.xxhash64("text"), "text").select("doc_id", "text", F.col("_to.own").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = ""
        for b in batches:
            docs_, guests = [], b.column(2).to_pylist()
            for doc, text, own_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), guests):
                if own_:
                    docs_.append((doc, text))
                else:
                    before = text  # guests come first: the document below this range
            if docs_:
                cols = list(zip(*_rows(docs_, before)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
                before = docs_[-1][1]

    return dealt.mapInArrow(run, OUT)


def _range_of(key, bounds: list[int]):
    """How many bounds are at or below the key, by halving: as many comparisons as the list's depth."""
    def below(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), below(lo, mid)).otherwise(below(mid + 1, hi))

    return below(0, len(bounds)).cast("int")

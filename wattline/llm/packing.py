"""Best-fit packing by bin completion with branch and bound (operator 10).

Documents become token ids; pieces of at most ``capacity`` ids are packed into
sequences.  Only the histogram of piece lengths (at most ``capacity`` rows)
reaches the driver.  The search works on length classes: the incumbent is the better of
the best-fit plan and the plan of the fullest fillings found.  Where it needs more
sequences than a lower bound says, ``branch`` goes depth first over the undominated
fillings of the largest class left and over how often each is applied, pruned by waste
against the incumbent, until nothing is left to try (the plan is then proven minimal)
or STEPS steps are done (the incumbent stands, unproven).  A plan has at most
``capacity`` + STEPS patterns, each of at most sqrt(2 * capacity) different lengths: a
proven bound for what the tasks receive.  Every piece then finds its place from its
rank in its length class; a class is ranked in salted parts, so one hot length is no
single task.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, mix, parts, text_chunks, texts

CAPACITY = 2048
STEPS = 100_000
CHUNK = 1 << 19  # bytes of text encoded at once
WORDS = 1_000_000  # whose ids a worker keeps
_SPACES = np.frombuffer(b" " * 8, "<u8")[0]
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of 8 bytes
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class _Slots(dict):
    """Numbers words in the order in which they are first looked up; ``new`` lists the latest."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Token ids of whole texts, encoding each distinct word once.

    The vocabulary's pattern drops white space and matches nothing across it, so
    the ids of a text are the ids of its space-separated words in order.  It also
    ignores case and ends a run of letters at a digit or mark, so words of Latin-1
    letters and ASCII are put together from their parts.  When the memory of words
    holds ``most`` of them, those seen once go, and all but the most frequent half
    of ``most``.
    """

    def __init__(self, path: str, most: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.slot = _Slots()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0  # ids of all words; room doubles
        self.at, self.n, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 1
        self.seen = np.zeros(1 << 16, np.int32)
        self.front = np.empty((1 << max(self.most.bit_length(), 4), 3), np.uint64)
        self.front[:] = _SPACES, _SPACES, 0  # the empty word

    def _forget(self) -> None:
        """Room for new words; counts are halved, so that words once frequent go in time."""
        seen = self.seen[:self.known]
        kept = np.flatnonzero(seen[1:] > 1) + 1
        kept = np.sort(kept[np.argsort(-seen[kept], kind="stable")[:self.most // 2]])
        words = list(self.slot)
        n = self.n[kept].astype(np.int64)
        end = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[kept] - end + n, n) + np.arange(n.sum())]
        self.slot = _Slots()
        self.slot.update((words[k], i) for i, k in enumerate(kept.tolist(), 1))
        self.known, self.used = len(kept) + 1, 0
        self._keep(ids)
        for of, value in ((self.n, n), (self.at, end - n), (self.seen, seen[kept] // 2)):
            of[0], of[1:self.known], of[self.known:] = 0, value, 0
        self.front[:] = _SPACES, _SPACES, 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` are put in ``flat``, behind those there."""
        at, self.used = self.used, self.used + len(ids)
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at:self.used] = ids
        return at

    def _learn(self) -> None:
        """Ids of the words that were looked up since the last call, word lists and id arrays being taken as wholes."""
        new, self.slot.new = self.slot.new, []
        while len(self.slot) > len(self.n):
            self.at, self.n, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.seen))
        plain = np.fromiter((m is not None for m in map(_PLAIN, new)), bool, len(new))
        number = np.arange(self.known, len(self.slot))
        for words, to, learn in ((list(compress(new, plain)), number[plain], self._learn_plain), (list(compress(new, ~plain)), number[~plain], self._learn_other)):
            if words:
                self.at[to], self.n[to] = learn(words)
        self.known = len(self.slot)

    def _learn_other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) of the words' ids in ``flat``, from the whole tokenizer."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return self._keep(np.fromiter(chain.from_iterable(ids), np.uint32, n.sum())) + np.cumsum(n) - n, n

    def _learn_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of Latin-1 letters and ASCII: a run of letters, a digit and a run of marks are a merge unit each.

        Units that are words seen before are taken from there, each other one is merged once.
        """
        units = _UNIT.findall(" ".join(words).lower())  # of all words, with a space between two words
        place = {u: i for i, u in enumerate(dict.fromkeys([" ", *units]))}
        have = np.fromiter(map(self.slot.get, place, repeat(self.known)), np.int64, len(place))
        todo = have >= self.known
        todo[0] = False
        have[have >= self.known] = 0  # the empty word, without ids, as for the space
        at, n = self.at[have], self.n[have].astype(np.int64)
        merge, before = self.tokenizer.model.tokenize, self.used
        ids = [[t.id for t in merge(u)] for u in _in_byte_chars(" ".join(compress(place, todo))).split()]
        n[todo] = m = np.fromiter(map(len, ids), np.int64, len(ids))
        at[todo] = self._keep(np.fromiter(chain.from_iterable(ids), np.uint32, m.sum())) + np.cumsum(m) - m

        of = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
        at, n = at[of], n[of]
        end = np.cumsum(n)
        put = self.flat[np.repeat(at - end + n, n) + np.arange(end[-1])]
        self.used = before  # the units' own ids are needed no longer
        upto = np.append(end[of == 0], end[-1])
        n = np.diff(upto, prepend=0)
        return self._keep(put) + upto - n, n

    def _numbers(self, batch: list[str]) -> np.ndarray:
        """The slots of all words of the texts, one after another.

        Words of at most 16 bytes are first sought in ``front``, a row per hash value with the bytes and
        the slot of the latest such word there: no Python string is made of those found.
        """
        raw = " ".join(batch).replace("\n", " ").encode()
        data = np.frombuffer(raw + b" " * 16, np.uint8)
        end = np.flatnonzero(data[:len(raw) + 1] == 32)
        start = np.concatenate([[0], end[:-1] + 1])
        size = end - start
        eight = np.ndarray(len(raw) + 9, "<u8", data, strides=(1,))  # the 8 bytes from each place on
        key = np.empty((len(start), 3), np.uint64)
        for i in (0, 1):
            own = _FIRST[np.clip(size - 8 * i, 0, 8)]
            key[:, i] = eight[start + 8 * i] & own | _SPACES & ~own  # no word has a space, so this says its length too
        row = (mix(key[:, 0] + mix(key[:, 1])) & np.uint64(len(self.front) - 1)).view(np.int64)
        there = self.front[row]
        out = there[:, 2].astype(np.int64)
        miss = np.flatnonzero((there[:, 0] != key[:, 0]) | (there[:, 1] != key[:, 1]) | (size > 16))
        out[miss] = np.fromiter(map(self.slot.__getitem__, [raw[s:e].decode() for s, e in zip(start[miss].tolist(), end[miss].tolist())]), np.int64, len(miss))
        miss = miss[size[miss] <= 16]
        key[miss, 2] = out[miss]
        self.front[row[miss]] = key[miss]
        return out

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.slot) > self.most:
            self._forget()
        flat = self._numbers(batch)
        self._learn()
        self.seen[:self.known] += np.bincount(flat, minlength=self.known)
        n = self.n[flat].astype(np.int64)
        end = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[flat] - end + n, n) + np.arange(end[-1])]
        cut = end[np.cumsum([t.count(" ") + t.count("\n") + 1 for t in batch]) - 1]
        return np.split(ids, cut[:-1])


def _byte_chars() -> str:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from 256 on; a space stays."""
    plain = [32, *range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter([c for c in range(256, 512) if c != 256 + 32])
    return "".join(chr(b) if b in plain else chr(next(other)) for b in range(256))


_BYTE_CHARS = _byte_chars()
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[!-&(-;=-~{_LETTERS}]+").fullmatch  # no ' of a contraction, no < of a special token
_UNIT = re.compile(f" |[{_LETTERS}]+|[0-9]|[^ 0-9{_LETTERS}]+")


def _in_byte_chars(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", _BYTE_CHARS)[0]


@lru_cache(maxsize=1)
def word_ids(path: str, most: int) -> WordIds:
    """One per worker process, so that the next task finds the words of the last."""
    return WordIds(path, most)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, last_id: int = 0, words_kept: int = WORDS) -> DataFrame:
    """Token pieces of whole texts: ids of the text, then ``last_id``; only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, words_kept)
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, values in text_chunks(b.column(1), CHUNK):
                out = []
                for doc, got in zip(ids[lo:hi], words.encode([v.decode() for v in values])):
                    got = np.append(got, np.uint32(last_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(got), capacity)):
                        piece = got[s:s + capacity]
                        out.append((doc, k, s, len(piece), zlib.crc32(piece.tobytes())))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


def _best_fit(left: np.ndarray, top: int, room: int) -> list[tuple[int, int]]:
    """The filling that takes the longest length that fits, again and again."""
    out, have = [], np.flatnonzero(left)
    while room > 0:
        i = np.searchsorted(have, room, "right") - 1
        while i >= 0 and (have[i] == 0 or left[have[i]] - (have[i] == top) <= 0):
            i -= 1
        if i < 0:
            break
        size = int(have[i])
        c = min(room // size, int(left[size]) - (size == top))
        out.append((size, c))
        room -= size * c
        have = have[:i]
    return out


def complete_bin(left: np.ndarray, top: int, capacity: int, nodes: int) -> list[tuple[int, int]]:
    """Lengths (with counts) that join one piece of length ``top``, with the least waste found.

    The best-fit filling is the incumbent.  Depth-first search takes lengths in
    falling order; a branch is cut when even all that is left below could not
    beat the incumbent's fill, a filling to which another piece still fits is
    dominated, and the search ends at no waste or after ``nodes`` nodes.
    """
    room = capacity - top
    best = _best_fit(left, top, room)
    best_fill = sum(s * c for s, c in best)
    sizes = [int(s) for s in np.flatnonzero(left[:room + 1])][::-1]
    if best_fill == room or not sizes:
        return best
    have = [int(left[s]) - (s == top) for s in sizes]
    below = np.concatenate([np.cumsum([s * c for s, c in zip(sizes, have)][::-1])[::-1], [0]])
    seen, stack = 0, [(0, 0, [])]
    while stack and seen < nodes and best_fill < room:
        i, fill, taken = stack.pop()
        seen += 1
        if fill > best_fill:
            best, best_fill = taken, fill
        if i >= len(sizes) or min(room, fill + int(below[i])) <= best_fill:
            continue
        stack.append((i + 1, fill, taken))
        for c in range(1, min(have[i], (room - fill) // sizes[i]) + 1):
            stack.append((i + 1, fill + c * sizes[i], taken + [(sizes[i], c)]))
    return best


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Sequences that the histogram ``left`` needs at least (Martello and Toth's L2).

    For every a up to half the capacity: pieces longer than half lie apart, those longer
    than capacity - a leave no room for a piece of a or more, and such pieces need what
    the others leave over, or further sequences.
    """
    n = np.cumsum(left)
    total = np.cumsum(left * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    large = int(n[capacity] - n[half])
    beside = capacity * (n[capacity - a] - n[half]) - (total[capacity - a] - total[half])
    small = total[half] - np.concatenate([[0], total[:half]])
    return large + max(0, int((-(-(small - beside) // capacity)).max()))


def _dominated(left: np.ndarray, inside: dict[int, int], slack: int) -> bool:
    """Whether a longer piece outside could take the place of one or two of those that join the longest.

    Exchanging them leaves no other sequence longer than before, so a plan with the filling is no better.
    """
    out = left.copy()
    for size, c in inside.items():
        out[size] -= c
    for x in inside:
        if slack and out[x + 1:x + slack + 1].any():
            return True
        for y in inside:
            if (y < x or y == x and inside[x] > 1) and out[x + y:x + y + slack + 1].any():
                return True
    return False


def fillings(left: np.ndarray, top: int, capacity: int, allowed: int) -> Iterator[list[tuple[int, int]] | None]:
    """The undominated fillings beside a piece of length ``top`` that waste at most ``allowed``; None is a step of the search without one."""
    room = capacity - top
    rest = left.copy()
    rest[top] -= 1
    sizes = [int(s) for s in np.flatnonzero(rest[:room + 1])][::-1]
    have = [int(rest[s]) for s in sizes]
    below = np.concatenate([np.cumsum([s * c for s, c in zip(sizes, have)][::-1])[::-1], [0]]).tolist()
    stack: list[tuple[int, int, list]] = [(0, 0, [])]
    while stack:
        i, fill, taken = stack.pop()
        while i < len(sizes) and sizes[i] > room - fill:
            i += 1
        if fill + below[i] < room - allowed:
            yield None
        elif i == len(sizes):
            yield None if _dominated(rest, dict(taken), room - fill) or _fits(rest, taken, room - fill) else taken
        else:
            yield None
            for c in range(min(have[i], (room - fill) // sizes[i]) + 1):
                stack.append((i + 1, fill + c * sizes[i], taken + [(sizes[i], c)] if c else taken))


def _fits(rest: np.ndarray, taken: list[tuple[int, int]], slack: int) -> bool:
    """Whether a further piece fits, so that the filling is dominated."""
    used = dict(taken)
    return any(rest[s] > used.get(int(s), 0) for s in np.flatnonzero(rest[:slack + 1]))


def branch(counts: dict[int, int], capacity: int, incumbent: list, bins: int, steps: int) -> tuple[list, bool]:
    """(plan, proven): the incumbent of ``bins`` sequences or a better plan; proven says that none needs fewer.

    A node is what is left; its branches are the undominated fillings of the largest length
    left, each applied as often as the class counts allow, then less often.
    """
    start = np.zeros(capacity + 1, np.int64)
    for size, c in counts.items():
        start[size] = c
    bound = lower_bound(start, capacity)
    best, least, done = incumbent, bins, 0
    seen: dict[bytes, int] = {}

    def key(left: np.ndarray) -> bytes:
        return hashlib.blake2b(left.tobytes(), digest_size=16).digest()

    def branches(left: np.ndarray, used: int) -> Iterator[tuple[list[tuple[int, int]], int] | None]:
        top = int(np.flatnonzero(left)[-1])
        total = int((left * np.arange(capacity + 1)).sum())
        again = []
        for fill in fillings(left, top, capacity, (least - 1 - used) * capacity - total):
            if fill is None:
                yield None
                continue
            bin_ = {top: 1}
            for size, c in fill:
                bin_[size] = bin_.get(size, 0) + c
            pattern = sorted(bin_.items(), reverse=True)
            most = min(int(left[size]) // c for size, c in pattern)
            again.append((pattern, most))
            yield pattern, most
        for pattern, most in again:
            for times in range(most - 1, 0, -1):
                yield pattern, times

    if least <= bound or not counts:
        return best, True
    path: list[tuple[list, int]] = []
    stack = [(start, 0, branches(start, 0))]
    while stack and least > bound:
        left, used, more = stack[-1]
        step = next(more, False)
        if step is False:
            stack.pop()
            if path:
                path.pop()
            continue
        done += 1
        if done > steps:
            return best, False
        if step is None:
            continue
        pattern, times = step
        after, now = left.copy(), used + times
        for size, c in pattern:
            after[size] -= c * times
        if not after.any():
            if now < least:
                best, least = [*path, step], now
            continue
        if now + lower_bound(after, capacity) >= least:
            continue
        name = key(after)
        if seen.get(name, now + 1) <= now:
            continue
        seen[name] = now
        path.append(step)
        stack.append((after, now, branches(after, now)))
    return best, True


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 2000, steps: int = STEPS, deep: int = 2) -> tuple[list[tuple[list[tuple[int, int]], int]], bool]:
    """((pattern, times), proven): a packing of the histogram ``counts`` (length -> pieces), and whether none needs fewer sequences.

    The plain best-fit plan is the first incumbent; the plan of the fullest fillings, each
    sought with ``nodes`` nodes, replaces it if it needs fewer sequences.  With hot lengths so
    does a plan of the counts divided by d (their common divisor, or the least of them),
    repeated d times, and of the remainders, planned likewise ``deep`` times.
    ``branch`` goes on from there.  The search is skipped where the incumbent meets the lower bound.
    """
    def build(search: bool) -> tuple[int, list]:
        left = np.zeros(capacity + 1, np.int64)
        for size, c in counts.items():
            left[size] = c
        plan, bins = [], 0
        while (there := np.flatnonzero(left)).size:
            top = int(there[-1])
            fill = complete_bin(left, top, capacity, nodes) if search else _best_fit(left, top, capacity - top)
            bin_: dict[int, int] = {top: 1}
            for size, c in fill:
                bin_[size] = bin_.get(size, 0) + c
            times = min(int(left[size]) // c for size, c in bin_.items())
            for size, c in bin_.items():
                left[size] -= c * times
            plan.append((sorted(bin_.items(), reverse=True), times))
            bins += times
        return bins, plan

    start = np.zeros(capacity + 1, np.int64)
    for size, c in counts.items():
        start[size] = c
    bound = lower_bound(start, capacity)
    bins, plan = build(False)
    if bins > bound:
        more, other = build(True)
        if more < bins:
            bins, plan = more, other
    shares = {gcd(*counts.values()), min(counts.values())} - {1} if bins > bound and deep else ()
    for d in sorted(shares):
        few, rest = {s: c // d for s, c in counts.items()}, {s: c % d for s, c in counts.items() if c % d}
        other = [(p, t * d) for p, t in best_plan(few, capacity, nodes, nodes, deep - 1)[0]] + best_plan(rest, capacity, nodes, nodes, deep - 1)[0]
        more = sum(t for _, t in other)
        if more < bins:
            bins, plan = more, other
        if bins <= bound:
            break
    return branch(counts, capacity, plan, bins, steps)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 2000, steps: int = STEPS) -> list[tuple[list[tuple[int, int]], int]]:
    """The packing of ``best_plan``."""
    return best_plan(counts, capacity, nodes, steps)[0]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, last_id: int = 0, nodes: int = 2000, words_kept: int = WORDS) -> DataFrame:
    """One row per piece with its sequence and its gapless place there.

    Null text is empty (its one piece is ``last_id`` alone); a null doc_id stays null;
    repeated rows are packed as often as they occur; an empty table gives no rows.
    ``words_kept`` trades a worker's memory for time, with the same rows.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "packing")
    pieces = keep.table("pieces", cut_pieces(docs, tokenizer, capacity, last_id, words_kept))
    salts = parts(spark)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    per_salt = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_bins(counts, capacity, nodes)

    # one entry per (pattern, length): the ranks of the class that it uses, and where they go
    entries, used, sequence = [], dict.fromkeys(counts, 0), 0
    for bin_, times in plan:
        offset = 0
        for size, c in bin_:
            entries.append((size, used[size], c, sequence, offset))
            used[size] += c * times
            offset += size * c
        sequence += times
    entries.sort()
    size, first, per, seq, off = (np.array(x, np.int64) for x in zip(*entries)) if entries else [np.zeros(0, np.int64)] * 5
    begin = {int(s): int(np.searchsorted(size, s)) for s in counts}

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(inside)).join(base, ["length", "_salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.zeros(len(length), np.int64)
            for s in np.unique(length):  # the entries of one length lie together, by rank
                m, lo = length == s, begin[int(s)]
                hi = int(np.searchsorted(size, s, "right"))
                at[m] = lo + np.searchsorted(first[lo:hi], rank[m], "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq[at] + nth // per[at]), pa.array(off[at] + nth % per[at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)

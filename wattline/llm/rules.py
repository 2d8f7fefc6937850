"""Quality rules as a learned decision list (operator 13).

Statistics of every whole text are counted once and written.  Those of labelled
documents (a bounded sample: the ``sample`` labels of least hash) train a list of rules
by sequential covering: a rule for the bad class grows by the threshold condition of
highest information gain on two thirds of the rows, is cut back to its most precise
beginning on the other third, and stays if it is precise enough there; the rows that it
covers leave, and the next rule is sought.  The list is emitted as an ordered Spark
conditional expression over ratios of the statistics, so that judging is one projection.

Statistics, the list and its verdicts cover all documents; two words or windows are equal
if 64-bit hashes of them are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, SpanHash, joined, mix, text_chunks, texts, word_spans

SAMPLE = 20_000  # labelled documents that the list is learned from
MOST_RULES, MOST_CONDITIONS = 16, 4
PRECISION = 0.9  # of a rule on the rows that it was not grown on
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_stops",
          "n_bangs", "n_echo", "n_blank")
#: what conditions are about: name -> (count, per what)
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "n_letters"), "digit_share": ("n_digits", "word_chars"),
    "letter_share": ("n_letters", "word_chars"), "bangs_per_word": ("n_bangs", "n_words"), "echo_share": ("n_echo", "n_words"),
    "blank_share": ("n_blank", "n_words"), "words_per_stop": ("n_words", "n_stops"), "words_per_line": ("n_words", "n_lines"),
}
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def count(values: list[bytes]) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text.

    Words are ``[^\\x20\\x09-\\x0D]+``; characters are code points; a line is what lies
    between line feeds, counted if it has a word, and a duplicate if an earlier line of the
    text is the same; repeated words lie in a window of three words that occurs twice or
    more in the text.  Bytes from 0x80 on count as letters.
    """
    n = len(values)
    data, starts = joined(values)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[starts[1:] - 1] - c[starts[:-1]]  # without the joining line feed

    ws, we = word_spans(data)
    owner = np.searchsorted(starts, ws, "right") - 1
    per = lambda mask: np.bincount(owner[mask], minlength=n).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    marks = np.concatenate([[0], np.cumsum(letter | digit, dtype=np.int64)])
    starts_point = (data & 0xC0) != 0x80
    h = SpanHash(data)(ws, we) if len(ws) else np.zeros(0, np.uint64)
    echo = np.zeros(len(ws), bool)
    echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])

    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(ws) > 2 else np.zeros(0, np.int64)
    window = mix(h[at] + mix(h[at + 1] * np.uint64(3) + mix(h[at + 2] * np.uint64(5) + np.uint64(11))))
    order = np.lexsort((window, owner[at]))
    same = (window[order][1:] == window[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 3, -1)
    covered = np.cumsum(edge)[:-1] > 0

    n_lines, n_dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, v in enumerate(values):
        lines = [line for line in v.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    chars = np.bincount(owner, weights=points[we] - points[ws], minlength=n).astype(np.int64)
    out = dict(n_words=np.bincount(owner, minlength=n).astype(np.int64), word_chars=chars, n_symbols=total(np.isin(data, _SYMBOLS)),
               n_dup_lines=n_dup, n_repeat_words=per(covered), n_lines=n_lines, n_letters=total(letter & starts_point), n_upper=total(upper),
               n_digits=total(digit), n_stops=total((data == 46) | (data == 63) | (data == 33)), n_bangs=total(data == 33), n_echo=per(echo),
               n_blank=per(marks[we] == marks[ws]))
    return {c: out[c] for c in COUNTS}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, values in text_chunks(b.column(1), 2 << 20):
                cols = count(values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(cols[c]) for c in COUNTS]], names=["doc_id", *COUNTS])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    """A ratio of two counts; 0 where there is nothing to divide by."""
    a, b = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # ratio >= threshold, or < threshold
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        return ratio(self.name) >= F.lit(self.threshold) if self.above else ratio(self.name) < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    right: int  # bad rows that it covers among those that it was not grown on
    wrong: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def between(low: float, high: float) -> float:
    """The shortest decimal in (low, high]."""
    for digits in range(1, 18):
        step = 10.0 ** (math.floor(math.log10(max(abs(low), abs(high)))) + 1 - digits)
        x = float(f"{math.floor(high / step) * step:.{digits}g}")
        if low < x <= high:
            return x
    return high


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition of highest gain: bad rows kept times the rise of the log of their share."""
    p, n = int(bad.sum()), int((~bad).sum())
    best, found = 1e-9, None
    before = math.log2(p / (p + n))
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows cut.. are at or above a threshold between two values
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        for above in (True, False):
            got = p - below if above else below
            size = len(v) - cut if above else cut
            gain = got * (np.log2(np.maximum(got, 1e-300) / size) - before)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, above, between(float(v[cut[k] - 1]), float(v[cut[k]])))
    return best, found


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = PRECISION, most_rules: int = MOST_RULES,
          most_conditions: int = MOST_CONDITIONS) -> list[Rule]:
    """Rules for the bad rows, by sequential covering; every third row is kept for pruning."""
    prune = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules:
        grow = left & ~prune
        if not bad[grow].any():
            break
        conditions: list[Condition] = []
        rows = np.flatnonzero(grow)
        while len(conditions) < most_conditions and not bad[rows].all():
            _, c = _best_condition(x[rows], bad[rows], names)
            if c is None:
                break
            conditions.append(c)
            rows = rows[c.holds(x[rows], names)]
        rest, chosen = np.flatnonzero(left & prune), None
        for k, c in enumerate(conditions):
            rest = rest[c.holds(x[rest], names)]
            p, n = int(bad[rest].sum()), int((~bad[rest]).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if p >= 2 and p >= precision * (p + n) and (chosen is None or worth > chosen[0] + 1e-12):
                chosen = (worth, Rule(tuple(conditions[:k + 1]), p, n))
        if chosen is None:
            break
        rules.append(chosen[1])
        covered = np.ones(len(bad), bool)
        for c in chosen[1].conditions:
            covered &= c.holds(x, names)
        left &= ~covered
    return rules


def fired(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that holds, 0 if none does."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(r.column(), i + 1) if out is None else out.when(r.column(), i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_from(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The list for ``labels`` (doc_id, quality 0 or 1) over the documents that pass the base rules.

    Of several labels of a document the worst counts, of several documents of an id the
    one of least statistics; null ids and labels are left out.
    """
    names = list(RATIOS)
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers are sent to all, and at most as many come back
    known = stats.where(~base_failed()).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("s"))
    rows = known.select("doc_id", "quality", "s.*").select("doc_id", "quality", *[ratio(r).alias(r) for r in names]).toPandas().sort_values("doc_id")
    if not len(rows):
        return []
    return learn(rows[names].to_numpy(np.float64), rows["quality"].to_numpy() == 0, names)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the rule that fired (0: none).

    Null and empty texts have no words and fail the base rules; a null doc_id stays null;
    repeated rows are judged alike; without labels, or with labels of one kind, no rule is
    learned and all that pass the base rules stay; an empty table gives no rows; other
    columns are not read.
    """
    stats = Scratch(docs.sparkSession, "rules").table("statistics", statistics(docs))
    rules = learn_from(stats, labels, sample)
    return stats.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), fired(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))

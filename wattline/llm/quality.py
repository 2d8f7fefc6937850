"""Weak-label quality classifier (operator 9).

Heuristic labellers vote good (1), bad (0) or abstain (-1) on every document.  Their
accuracies are not given: expectation-maximisation over the counts of vote patterns
(at most 3 ** labellers of them) estimates, per labeller and class, how often it votes
what, and the share of good documents.  The posterior of a pattern is the label that
trains a hashed linear scorer: square roots of byte-trigram shares and the votes, in
one hashed space, fitted by logistic regression on a bounded sample of documents
(the ``sample`` with the smallest hashes of doc_id and text, equal rows taken once).  Votes, pattern counts,
estimates and scores cover all documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, SpanHash, is_space, joined, mix, text_chunks, texts, word_spans

DIM = 4096
VOTE_VALUE = 0.6
SAMPLE = 4000
VARIETY_WORDS = 500
CHUNK = 1 << 20
LABELLERS = ("symbols", "capitals", "letters", "echo", "variety", "shouting", "sentences", "separators", "word_length")
OUT = "doc_id long, votes string, posterior double, score double, keep boolean"


def votes_of(values: list[bytes]) -> np.ndarray:
    """(len(values), len(LABELLERS)) votes.

    Bytes from 0x80 on count as letters, so that all scripts read alike; a text of
    fewer than five words gets no vote on its words, and an empty one none at all.
    Variety is the share of words that are new in their block of VARIETY_WORDS words.
    """
    n = len(values)
    data, starts = joined(values)
    size = np.diff(starts) - 1  # without the joining line feed

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[starts[1:]] - c[starts[:-1]]

    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    filled = ~is_space(data)
    odd = filled & ~letter & ~((data >= 48) & (data <= 57)) & ~np.isin(data, np.frombuffer(b".,;:!?'\"()-/", np.uint8))
    n_letter, n_filled = total(letter), np.maximum(total(filled), 1)
    n_alnum = n_letter + total((data >= 48) & (data <= 57))
    ws, we = word_spans(data)
    owner = np.searchsorted(starts, ws, "right") - 1
    words = np.bincount(owner, minlength=n)
    h = SpanHash(data)(ws, we) if len(ws) else np.zeros(0, np.uint64)
    echo = np.zeros(len(ws), bool)
    echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    block = (np.arange(len(ws)) - np.searchsorted(owner, owner)) // VARIETY_WORDS  # of the word in its text
    order = np.lexsort((h, block, owner))
    new = np.ones(len(ws), bool)  # words that are new in their block, so that long texts vary as short ones do
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]) | (block[order][1:] != block[order][:-1])
    letters_to = np.concatenate([[0], np.cumsum(letter | ((data >= 48) & (data <= 57)))])
    blank = letters_to[we] == letters_to[ws]  # words without a letter or digit
    many = np.maximum(words, 1)
    per_word = lambda mask: np.bincount(owner, weights=mask, minlength=n) / many
    foreign = total(data >= 128) / n_filled > 0.5  # scripts that may not part words by spaces
    stops = total((data == 46) | (data == 63) | (data == 33))

    def vote(bad: np.ndarray, good: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known & bad, 0, np.where(known & good, 1, -1))

    some, prose = size >= 20, (words >= 5) & ~foreign
    variety = np.bincount(owner[order], weights=new, minlength=n) / many
    odd_share, caps, plain = total(odd) / n_filled, total(upper) / np.maximum(n_letter, 1), n_alnum / n_filled
    echoes, shout, bars = per_word(echo), total(data == 33) / many, per_word(blank)
    per_stop, length = words / np.maximum(stops, 1), n_filled / many
    return np.stack([
        vote(odd_share > 0.03, odd_share < 0.01, some),
        vote(caps > 0.4, caps < 0.2, some & (n_letter >= 10)),
        vote(plain < 0.86, plain > 0.91, some),
        vote(echoes > 0.2, echoes < 0.05, prose),
        vote((variety < 0.25) & (words >= 20), variety > 0.45, prose),
        vote(shout > 0.2, shout < 0.05, prose),
        vote((per_stop > 80) & (words >= 80), (per_stop >= 3) & (per_stop <= 40), prose),
        vote(bars > 0.1, bars < 0.03, prose),
        vote((length < 3) | (length > 12), (length >= 4) & (length <= 8), prose & (words >= 10)),
    ], axis=1).astype(np.int8)


def pattern(votes: np.ndarray) -> list[str]:
    """Votes as text, a character per labeller: + good, - bad, . abstained."""
    return ["".join(".-+"[v + 1] for v in row) for row in votes.tolist()]


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], float, np.ndarray]:
    """(posterior of good per pattern, share of good, P(vote | class, labeller)) by expectation-maximisation.

    The first posterior is the share of good votes.  Votes of different labellers
    count as independent given the class.  Counts are smoothed by one vote.
    """
    names = sorted(patterns)
    if not names:
        return {}, 0.5, np.full((2, 0, 2), 0.5)
    count = np.array([patterns[p] for p in names], np.float64)
    v = np.array([[".-+".index(c) for c in p] for p in names])
    good, bad = (v == 2).sum(1), (v == 1).sum(1)
    post = (good + 1) / (good + bad + 2)
    onehot = np.eye(3)[v][:, :, 1:]  # pattern, labeller, vote; abstaining says nothing
    for _ in range(rounds):
        each = np.stack([count * (1 - post), count * post])
        share = (each.sum(1) + 1) / (count.sum() + 2)
        table = np.einsum("cp,plv->clv", each, onehot) + 1
        table /= table.sum(2, keepdims=True)
        logit = np.log(share)[:, None] + np.einsum("plv,clv->cp", onehot, np.log(table))
        now = 1 / (1 + np.exp(np.clip(logit[0] - logit[1], -500, 500)))
        done = np.abs(now - post).max() < 1e-9
        post = now
        if done:
            break
    return dict(zip(names, post.tolist())), float(share[1]), table


def _vote_index() -> np.ndarray:
    k = np.arange(2 * len(LABELLERS), dtype=np.uint64).reshape(-1, 2)
    return (mix(k + np.uint64(99)) % np.uint64(DIM)).astype(np.int64)


def features_of(values: list[bytes], votes: np.ndarray) -> Iterator[np.ndarray]:
    """One hashed vector per value: roots of trigram shares, of length 1, plus the votes."""
    at = _vote_index()
    for v, row in zip(values, votes):
        x = np.zeros(DIM)
        if len(v) >= 3:
            b = np.frombuffer(v, np.uint8)
            gram = (b[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + b[1:-1].astype(np.uint32) * np.uint32(0x85EBCA6B)
                    + b[2:].astype(np.uint32) * np.uint32(0xC2B2AE35))
            x = np.sqrt(np.bincount((gram ^ (gram >> np.uint32(15))) & np.uint32(DIM - 1), minlength=DIM) / len(gram))
        voted = np.flatnonzero(row >= 0)
        np.add.at(x, at[voted, row[voted]], VOTE_VALUE)
        yield x


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.4, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels, full-batch with momentum: the same weights on every run."""
    w, vw, b, vb = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 0.0, 0.0
    for _ in range(rounds if len(y) else 0):
        err = (1 / (1 + np.exp(-np.clip(x @ w + b, -80, 80))) - y).astype(x.dtype)
        vw = (0.9 * vw - rate * (err @ x / len(y) + ridge * w)).astype(x.dtype)
        vb = 0.9 * vb - rate * float(err.mean(dtype=np.float64))
        w, b = w + vw, b + vb
    return w.astype(np.float64), b


@dataclass
class Classifier:
    posterior: dict[str, float]  # of each pattern seen: at most 3 ** labellers
    share: float
    weights: np.ndarray
    bias: float


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for lo, hi, values in text_chunks(b.column(1), CHUNK):
            yield ids[lo:hi], values


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    spark = docs.sparkSession
    d = texts(docs).select(F.xxhash64(F.lit(9), "doc_id", "text").alias("h"), "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, values in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(pattern(votes_of(values)))], names=["h", "votes"])

    keep = Scratch(spark, "quality")
    votes = keep.table("votes", d.mapInArrow(vote, "h long, votes string"))
    seen = votes.groupBy("votes").count().collect()  # at most 3 ** labellers rows
    posterior, share, _ = estimate({r["votes"]: r["count"] for r in seen})
    last = votes.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    keep.drop("votes")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, values in _batches(batches):
            v = votes_of(values)
            x = [f.astype("<f2").tobytes() for f in features_of(values, v)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(pattern(v)), pa.array(x, pa.binary())], names=["h", "votes", "x"])

    chosen = (d.where(F.col("h") <= F.lit(last)) if last is not None else d.limit(0)).dropDuplicates(["h"])  # at most ``sample`` rows
    rows = chosen.mapInArrow(vectors, "h long, votes string, x binary").collect()
    rows.sort(key=lambda r: r["h"])
    x, y = np.empty((len(rows), DIM), np.float32), np.array([posterior[r["votes"]] for r in rows], np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(bytes(r["x"]), "<f2")
    del rows
    w, b = fit_linear(x, y)
    return Classifier(posterior, share, w, b)


def _scores(model: Classifier, values: list[bytes], least: float) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
    """Votes, posterior, score and decision: good scores stay, and so do texts on which every labeller abstains."""
    v = votes_of(values)
    names = pattern(v)
    logit = np.fromiter((x @ model.weights for x in features_of(values, v)), np.float64, len(values))  # one vector at a time
    score = 1 / (1 + np.exp(-np.clip(logit + model.bias, -500, 500)))
    return names, [model.posterior.get(p, model.share) for p in names], score, (score >= least) | (v < 0).all(axis=1)


def judge(docs: DataFrame, model: Classifier, least: float = 0.5) -> DataFrame:
    """votes, posterior, score and keep for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _batches(batches):
            names, post, score, keep = _scores(model, values, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(post, pa.float64()), pa.array(score), pa.array(keep)],
                                             names=["doc_id", "votes", "posterior", "score", "keep"])

    return texts(docs).mapInArrow(run, OUT)


def keep_good(docs: DataFrame, model: Classifier, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, values in text_chunks(b.column(at), CHUNK):
                yield b.slice(lo, hi - lo).filter(pa.array(_scores(model, values, least)[3]))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Votes, posterior, score and decision for every document.

    Null and empty texts get no votes, so their posterior is near the share of good
    documents; a null doc_id stays null; repeated rows are judged alike; an empty
    table gives no rows.
    """
    return judge(docs, train(docs, sample), least)

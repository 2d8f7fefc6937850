"""Statistics against plain counts; the learned list on planted thresholds and on labels it did not see."""

import random
from collections import Counter

import numpy as np
from brute import WORDS

from wattline.llm import rules

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(spark, awkward, no_docs):
    texts = ["a b c a b c", "a a a a", "x\n x\nx\n\n \nx", "a b c\na b c", "é|ö #*$%&<> b", "w " * 60, "\x0b\x0c\r\n\x85\xa0"]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + list(enumerate(texts, 900))
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 900)), "doc_id long, text string"))
    got = Counter(tuple(r)[:6] for r in rules.statistics(docs).collect())
    assert got == Counter((d, *plain(t)) for d, t in rows)
    assert rules.statistics(no_docs).count() == 0


def test_base_rules_and_no_labels(spark, awkward, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 0, 0), (1, None, 0), (5, 1, 0), (5, 1, 1), (5, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = rules.judge(awkward, labels).collect()
        assert Counter((r["doc_id"], r["n_words"]) for r in out) == Counter((r["doc_id"], len(WORDS.findall(r["text"] or ""))) for r in awkward.collect())
        for r in out:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert r["kept"] == (not r["base_failed"]) and r["rule"] == 0
    assert rules.judge(no_docs, odd).count() == 0


def test_learned_list_finds_planted_thresholds():
    rnd = np.random.default_rng(3)
    x = rnd.random((3000, 4))
    bad = (x[:, 0] >= 0.9) | ((x[:, 1] < 0.3) & (x[:, 2] >= 0.7))
    found = rules.learn(x, bad, list("abcd"))
    hit = np.zeros(3000, bool)
    for r in found:
        one = np.ones(3000, bool)
        for c in r.conditions:
            one &= c.holds(x, list("abcd"))
        hit |= one
    assert (hit == bad).mean() > 0.99
    assert {c.name for r in found for c in r.conditions} <= {"a", "b", "c"}
    assert rules.learn(x, rnd.random(3000) < 0.3, list("abcd")) == []  # nothing to learn
    assert rules.learn(x, np.zeros(3000, bool), list("abcd")) == [] == rules.learn(x[:0], bad[:0], list("abcd"))
    assert rules.learn(x, np.ones(3000, bool), list("abcd")) == []  # nothing to tell apart


def test_thresholds_are_short_decimals():
    rnd = random.Random(1)
    for _ in range(2000):
        a, b = sorted(rnd.choice([rnd.random(), rnd.gauss(0, 1e4), rnd.gauss(0, 1e-6)]) for _ in range(2))
        if a < b:
            assert a < rules.between(a, b) <= b
    assert rules.between(0.0, 0.37) == 0.3 and rules.between(0.123, 0.456) == 0.4 and rules.between(-0.5, 0.0) <= 0.0


def test_expression_is_the_list(spark):
    """The conditional expression and the list itself agree row by row, order included."""
    some = [rules.Rule((rules.Condition("symbols_per_word", True, 0.3),), 5, 0),
            rules.Rule((rules.Condition("upper_share", True, 0.5), rules.Condition("chars_per_word", False, 6.0)), 3, 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(500)
    names = list(rules.RATIOS)
    stats = rules.statistics(docs)
    rows = stats.select(rules.fired(some).alias("got"), *[rules.ratio(n).alias(n) for n in names]).toPandas()
    x = rows[names].to_numpy()
    want = np.zeros(len(rows), int)
    for k in (2, 1):
        hit = np.ones(len(rows), bool)
        for c in some[k - 1].conditions:
            hit &= c.holds(x, names)
        want[hit] = k
    assert rows["got"].tolist() == want.tolist() and set(want) >= {0, 1}


def test_held_out_labels(spark):
    """Learned on half of the labels, the list keeps clean documents of the other half and rejects the others."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = rules.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean, poor = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert clean.kept.mean() > 0.99 and poor.kept.mean() < 0.01 and len(clean) > 1000 and len(poor) > 200

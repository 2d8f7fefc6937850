"""Manifest proofs against a plain tree, on awkward rows and at every superblock size."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wattline.llm import merkle


def H(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, n = row
    parts = [doc, source, lang, None if n is None else n + more, text]
    return H(*["-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts])


def prove(nodes):
    """(root, steps per node): a step is (side, sibling) or None."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            other = a ^ 1
            steps[i].append(None if other >= len(nodes) else ("L" if other < a else "R", nodes[other]))
        nodes = [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], steps


def brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = prove([leaf(r) for r in langs[name]])
    root, above = prove([trees[name][0] for name in names])
    out = Counter()
    for i, name in enumerate(names):
        for r, own in zip(langs[name], trees[name][1]):
            steps = own + above[i]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf(r, 1 if hit else 0)
            for s in steps:
                x = H(x) if s is None else H(s[1], x) if s[0] == "L" else H(x, s[1])
            out[r[0], leaf(r), trees[name][0], root, H(*[s[1] for s in steps if s]), x, x == root] += 1
    return out


def some_rows(awkward):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in awkward.collect()]


def test_awkward_rows(awkward, no_docs):
    assert Counter(tuple(r) for r in merkle.verify_tampered(awkward).collect()) == brute(some_rows(awkward))
    assert merkle.verify_tampered(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 33])
def test_any_size_in_superblocks_of_four(spark, n):
    rows = [(i * 3 % 97, f"text {i}", ["en", "é", None, "de"][i % 4 if n > 8 else 0], "s", i if i % 3 else None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    changed = F.when(merkle.tampered(), merkle.leaf_of(n_chars=F.col("n_chars") + 1)).otherwise(merkle.leaf_of())
    got = merkle.manifest(docs, changed, bits=2).collect()
    want = brute(rows)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["folded_root"] == r["root"]) for r in got) == want
    for r in got:  # the proof itself
        assert merkle.fold(r["leaf"], r["proof"]) == r["root"]
        assert H(*[s[1:] for s in r["proof"]]) == r["proof_sha256"]


def test_a_changed_row_does_not_fold_to_the_root(spark, awkward):
    out = merkle.verify_tampered(awkward).collect()
    for r in out:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        null = [x for x in some_rows(awkward) if x[0] == r["doc_id"] and leaf(x) == r["leaf"]][0][4] is None
        assert r["verified"] == (not hit or null)


def test_largest_n_chars_is_no_overflow(spark):
    rows = [(i, "t", "en", "s", 2**63 - 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r) for r in merkle.verify_tampered(docs).collect()) == brute(rows)

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, key int, bucket string, votes string"


def prose(rnd: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(rnd.choice("aeiou") + str(rnd.randrange(vocabulary)) + rnd.choice(["", "x", "é", "."]) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, equal and near copies, repeated rows and ids, shared passages."""
    rnd = random.Random(5)
    base, passage = prose(rnd, 120), prose(rnd, 90)
    words = base.split(" ")
    near = words[:50] + ["changed"] + words[51:]
    texts = [None, "", " \n\t ", "one", "one two three", base, base, " ".join(near), base.upper(), passage,
             prose(rnd, 40) + " " + passage + " " + prose(rnd, 30), prose(rnd, 25) + "\n" + passage + "\n", prose(rnd, 20_000, 5_000),
             "ab" * 700, "ab" * 700 + "c", "a" * 399, "a" * 400, "a" * 401, "é" * 300, "日本語の文章です。" * 60, "line\n" * 300, "\x00\x1f\x85\xa0 x"]
    texts += [prose(rnd, rnd.randrange(1, 300)) for _ in range(18)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), "x", 1, "y", "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (3, "another text with the id three", "en", "s1", 30, None, None, None, None),
             (None, "no id at all", None, None, None, None, None, None, None), (None, base, None, "s9", 5, None, None, None, None),
             (-7, base + " tail", "fr", "s0", 9, None, None, None, None)]
    return rows


#: names that operators use, or used, inside
CLASHING = ("copy", "spans", "grams", "fate", "_k", "_text", "_id", "_kept", "carried", "row", "id", "cut", "c0", "t", "h", "x", "node", "grp", "pos", "n",
            "mix_source", "mix_block", "mix_pass", "pass", "tokens", "sig", "first", "component_id", "kept", "settled", "_range", "_key")


def with_clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every trouble, and extra columns whose names the operators use inside."""
    return with_clashing(spark.createDataFrame(awkward_rows(), DOCS).repartition(3)).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashing(spark.createDataFrame([], DOCS))

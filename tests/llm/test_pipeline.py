"""Registration, and the pipeline's stages against brute force on the rows that each one gets."""

from collections import Counter

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle_compare import compare, duck
from wattline.llm import quality, registry

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = Counter(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == Counter(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    got = compare(registry.QUERIES[name](spark, SF), duck(SF), registry.SQL[name])
    assert got["rows_match"] and got["hash_match"], got


def test_stages_one_by_one(spark, awkward, no_docs, tmp_path):
    docs = awkward
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        rows = [(r["doc_id"], r["text"]) for r in before]
        out = stage(spark, docs, SF)
        assert stage(spark, no_docs, SF).count() == 0
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = [(r["doc_id"], r["text"]) for r in out.collect()] if i < 4 else None
        if i < 4:
            assert out.columns == docs.columns
        if name == "quality_classifier":
            keep = quality.classify(docs).where("keep").select("doc_id").collect()
            assert Counter(d for d, _ in got) == Counter(r["doc_id"] for r in keep)
        elif name == "minhash_near_dedup":
            assert {(d, t or "") for d, t in got} == {(d, t or "") for (d, t), (_, _, c) in zip(rows, brute.near_groups(rows, 5)) if d == c}
        elif name == "suffix_array_dedup":
            assert Counter(got) == Counter((d, k.decode(errors="ignore")) for (d, _), (k, _) in zip(rows, brute.without_repeats([t for _, t in rows], corpus_pipeline.PASSAGE)))
        elif name == "source_mixing":
            assert set(got) == set(rows)  # every document at least once
        else:
            ends = {}
            for r in sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == ends.get(r["sequence_id"], 0)
                ends[r["sequence_id"]] = r["offset"] + r["length"]
            assert len(ends) == -(-sum(ends.values()) // 2048)
            assert {r["doc_id"] for r in out.collect()} == {d for d, _ in rows}
        docs = out


def test_near_dedup_stage_compares_five_words(spark):
    """Ten spaced edits of 400 words are near copies on four words, not on five; four edits are on both."""
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))] + [(n, " ".join(f"e{n}_{i}" if i % 39 == 20 and i < 39 * n else w for i, w in enumerate(base))) for n in (4, 10)]
    assert [c for _, _, c in brute.near_groups(rows, 4)] == [0, 0, 0]
    assert [c for _, _, c in brute.near_groups(rows, 5)] == [0, 0, 10]
    out = corpus_pipeline.minhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r["doc_id"] for r in out.collect()} == {0, 10}


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and (got.piece == 0).sum() > 100

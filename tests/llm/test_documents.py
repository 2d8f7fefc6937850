"""Operators on documents against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wattline.llm import common, fingerprint, katz, mixing, neardup, packing, quality, suffix, tokencount
from wattline.llm.common import Scratch

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_token_attribution(awkward, no_docs):
    import tokenizers

    got = tokencount.attribute_tokens(awkward, RANKS, public_tokenizers.PATTERN).toPandas()
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    n = Counter()
    for doc, text in pairs(awkward):
        n[doc] += len(whole.encode(text or "", add_special_tokens=False).ids)
    for rule in ("tokens_start", "tokens_majority", "tokens_fraction"):
        sums = got.groupby("doc_id", dropna=False)[rule].sum()
        for doc, tokens in n.items():
            mine = sums[sums.index.isna()].iloc[0] if doc is None else sums[doc]
            assert mine == pytest.approx(tokens), (rule, doc)
    assert (got.groupby("doc_id").section.nunique() >= 1).all()
    assert tokencount.attribute_tokens(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokens_across_sections_are_allocated_by_rule():
    start, end = np.array([0, 3, 5]), np.array([3, 5, 9])
    overlap, crossing, first, most, part = tokencount.attribute(start, end, np.array([0, 4, 6]), 9)
    assert overlap.tolist() == [2, 2, 1] and crossing.tolist() == [1, 2, 1]
    assert first.tolist() == [2, 1, 0] and most.tolist() == [2, 0, 1]  # a tie goes to the earlier section
    assert part.tolist() == pytest.approx([1.5, 0.75, 0.75])


def test_fingerprints(awkward, no_docs, spark):
    got = fingerprint.fingerprints(awkward).collect()
    rows = {}
    for doc, text in sorted(set(pairs(awkward)), key=str):
        rows.setdefault(doc, []).append(text or "")
    assert len(got) == awkward.count()
    by_text = {}
    single = sorted((d for d in rows if d is not None and len(rows[d]) == 1 and d != 5), reverse=True)
    mine = {r["doc_id"]: r for r in got if r["doc_id"] in single}
    everyone = sorted((d for d in rows if d is not None), reverse=True)
    for d in single:
        below = everyone[everyone.index(d) + 1] if d != everyone[-1] else None
        text, r = rows[d][0], mine[d]
        assert r["n_chars"] == len(text)
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if below in mine:
            assert r["edited_sha256"] == brute.sha(brute.edited(text, rows[below][0]))
    assert fingerprint.fingerprints(no_docs).count() == 0
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0  # a lone document follows itself


def test_peeling_equals_set_difference():
    rnd = np.random.default_rng(1)
    for n, m, both in ((0, 0, 0), (3, 0, 0), (0, 4, 2), (40, 60, 500), (700, 900, 50)):
        x = rnd.integers(0, 1 << 63, n + m + both, dtype=np.uint64)
        a, b = x[:n + both], x[n:]
        near, cells = fingerprint.likeness((a, np.array([0, len(a)])), np.array([0]), (b, np.array([0, len(b)])), np.array([0]))
        assert near[0] == pytest.approx(both / len(x) if len(x) else 1.0)
        assert cells[0] > 0


def test_katz(awkward, no_docs):
    rows = pairs(awkward)
    model = brute.Katz([t for d, t in rows if not brute.held_out(d)], katz.K, katz.D_LARGE, katz.discounts)
    for h in [0, *list(model.count)[:20]]:
        assert sum(model.p2(h, w) for w in model.uni) + model.alpha[h] * model.unknown == pytest.approx(1)
    got = katz.score_documents(awkward).collect()
    want = Counter((d, brute.held_out(d), *model.score(t)[:2], model.n, *(round(x, 6) for x in model.score(t)[2:])) for d, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert katz.score_documents(no_docs).count() == 0


def test_katz_splits_hot_and_frequent_words(spark, monkeypatch):
    rows = [(i, "the " * (i % 7) + f"word{i % 5} the end{i}") for i in range(60)]
    model = brute.Katz([t for d, t in rows if not brute.held_out(d)], katz.K, katz.D_LARGE, katz.discounts)
    monkeypatch.setattr(katz, "FREQUENT", 50)  # most words travel as hashes, "the" as a number
    monkeypatch.setattr(katz, "SLICE", 100)
    got = katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got} == {
        d: (*model.score(t)[:2], *(round(x, 6) for x in model.score(t)[2:])) for d, t in rows}


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if brute.held_out(i))
    r = katz.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("length, common", [(400, 4096), (60, 1), (60, 20)])
def test_repeated_strings(awkward, no_docs, monkeypatch, length, common):
    monkeypatch.setattr(suffix, "COMMON", common)  # 1: no key is common
    rows = pairs(awkward)
    want = Counter((d, len((t or "").encode()), len((t or "").encode()) - len(kept), spans, brute.sha(kept))
                   for (d, t), (kept, spans) in zip(rows, brute.without_repeats([t for _, t in rows], length)))
    got = suffix.remove_repeats(awkward, length).collect()
    assert Counter(tuple(r) for r in got) == want
    assert suffix.remove_repeats(no_docs).count() == 0


def test_planted_passages_are_found(spark):
    """Every row of a whole table with planted passages of 400 to 2,000 bytes, in few or in very many documents, against brute force."""
    rnd = random.Random(11)
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    texts = dict(docs)
    planted = Counter()
    for k, size in enumerate([400, 401, 431, 500, 777, 1200, 2000, 450]):
        passage = " ".join(f"{rnd.choice('aeiou')}{rnd.randrange(10**6)}" for _ in range(400))[:size]
        assert len(passage.encode()) == size
        for doc in rnd.sample(sorted(texts), [2, 3, 5, 20, 40, 3, 2, 500][k]):  # the last in half of all documents
            at = rnd.randrange(len(texts[doc]) + 1)
            texts[doc] = texts[doc][:at] + passage + texts[doc][at:]
            planted[doc] += size
    rows = sorted(texts.items())
    want = Counter((d, len(t.encode()), len(t.encode()) - len(kept), spans, brute.sha(kept)) for (d, t), (kept, spans) in zip(rows, brute.without_repeats([t for _, t in rows])))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert all(r["n_removed"] >= min(400, planted[r["doc_id"]]) for r in got) and len(planted) > 500


def test_cut_repeats_keeps_columns_and_whole_characters(awkward):
    out = suffix.cut_repeats(awkward)
    assert out.schema == awkward.schema
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    kept = Counter(k.decode(errors="ignore") for k, _ in brute.without_repeats([t for _, t in pairs(awkward)]))
    assert Counter(r["text"] for r in rows) == kept


@pytest.mark.parametrize("shared", [{}, {"ESTIMATE_FROM": 0.0}])
def test_near_duplicates(awkward, no_docs, monkeypatch, shared):
    for k, v in shared.items():
        monkeypatch.setattr(neardup, k, v)
    got = neardup.near_duplicates(awkward).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.near_groups(pairs(awkward)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_links_between_members_that_the_leader_misses(spark):
    """A chain: each text is near the next, the ends are not near each other, and one component holds all."""
    import random

    rnd = random.Random(2)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    rows += [(100 + i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(10)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute.near_groups(rows))


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that one step turns into stars get one step; a path gets as many as it needs."""
    made, table = [], Scratch.table

    def noted(self, name, df):
        made.append(name)
        return table(self, name, df)

    monkeypatch.setattr(Scratch, "table", noted)
    keep = Scratch(spark, "components")
    star = spark.createDataFrame([(9, 1), (1, 8), (7, 1), (5, 4), (4, 4), (9, 1)], "a long, b long")
    assert sorted(map(tuple, neardup.components(star, keep, "star").collect())) == [(5, 4), (7, 1), (8, 1), (9, 1)]
    assert made == ["star-0", "star-1"]
    path = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (53, 52), (50, 53)], "a long, b long")
    assert dict(map(tuple, neardup.components(path, keep, "path").collect())) == {i: 1 for i in range(2, 41)} | {51: 50, 52: 50, 53: 50}
    assert neardup.components(path.limit(0), keep, "none").count() == 0


def test_fine_estimate_is_a_short_condition(spark):
    """32 words written out in a join's condition make a method that the JVM does not compile."""
    df = spark.createDataFrame([(1, [0] * 32), (1, [-1] + [0] * 31)], "key long, fine array<long>")
    both = df.withColumnRenamed("fine", "fa").join(df.withColumnRenamed("fine", "fb"), "key").where(neardup.fine_estimate("fa", "fb") >= 0.95)
    assert sorted(r[0] for r in both.select(neardup.fine_estimate("fa", "fb")).collect()) == [1.0, 1.0]
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and 0 < plan.count("bit_count") < 8


def test_estimates_of_short_sets_keep_every_link(spark):
    """Pairs of a few shingles at a similarity of exactly 0.8, by (common, only left, only right)."""
    rnd, rows, pairs_ = np.random.default_rng(4), [], []
    for common, left, right in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (12, 3, 0), (16, 4, 0), (24, 6, 0)):
        for _ in range(200):
            x = rnd.permutation(np.unique(rnd.integers(0, 1 << 63, common + left + right, dtype=np.uint64)))
            pairs_.append((np.sort(x[:common + left]), np.sort(np.delete(x, np.s_[common:common + left]))))
    for k, (a, b) in enumerate(pairs_):
        rows += [(f"{k}a".encode(), a.tobytes()), (f"{k}b".encode(), b.tobytes())]
    sets = [np.frombuffer(v, np.uint64) for _, v in rows]
    sigs = neardup.packed(neardup.minima(np.concatenate(sets), np.cumsum([0, *map(len, sets)])))
    fine = dict(tuple(r) for r in neardup.fine_signatures(spark.createDataFrame(rows, "cls binary, shingles binary").coalesce(1)).collect())
    got = spark.createDataFrame([(fine[rows[i][0]], fine[rows[i + 1][0]], sigs[i].tolist(), sigs[i + 1].tolist()) for i in range(0, len(rows), 2)],
                                "fa array<long>, fb array<long>, a array<long>, b array<long>").select(
        neardup.fine_estimate("fa", "fb").alias("fine"), neardup.estimate("a", "b").alias("rough")).toPandas()
    assert (got.fine >= neardup.FINE_FROM).all() and (got.rough >= neardup.ESTIMATE_FROM).all()
    for i in range(0, len(got), 200):  # the spread is that of independent positions, for sets of any size
        assert got.fine[i:i + 200].std() == pytest.approx(2 * (0.1 * 0.9 / neardup.FINE) ** 0.5, rel=0.3)


def test_signing_keeps_little_memory(monkeypatch):
    """A worker signs a large batch in small parts: the tables of powers that it keeps stay at 8 MB each."""
    import pyarrow as pa

    class Here:
        def withColumn(self, *a):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    monkeypatch.setattr(common, "_POWERS", {})
    monkeypatch.setattr(neardup, "texts", lambda docs: docs)
    monkeypatch.setattr(neardup.F, "xxhash64", lambda *a: None)
    n = 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"{i} word " * 200 for i in range(n)]), pa.array(range(n))], names=["doc_id", "text", "text_key"])
    out = neardup.signed(Here())
    assert sum(b.num_rows for b in out) == n and len(out) > 1
    assert max(map(len, common._POWERS.values())) <= 1 << 20


def test_keep_one_of_each_group(awkward):
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = {(d, t or "") for (d, t), (_, _, c) in zip(pairs(awkward), brute.near_groups(pairs(awkward))) if d == c}
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_mixing_meets_its_target(awkward, no_docs, spark):
    tokens = mixing.count_tokens(awkward)
    n = Counter()
    for d, t in pairs(awkward):
        n[d] += len(brute.WORDS.findall(t or ""))
    assert {r["doc_id"]: r["n"] for r in tokens.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == n
    plan = mixing.plan(tokens, repetition=1.5, block_tokens=200)
    rows = [r for r in plan.sources.collect() if r["tokens"]]
    ratio = [r["weight"] / r["share"] for r in rows]
    assert max(ratio) / min(ratio) == pytest.approx(1.5, abs=1e-5) or plan.exponent == 0
    assert sum(r["weight"] for r in rows) == pytest.approx(1)
    out = mixing.apply(awkward.select("doc_id", "text", "source"), plan)
    again = mixing.repeat(awkward, plan)
    assert again.columns == awkward.columns and again.count() == out.count()
    longest = max(n.values())
    used = {r["mix_source"]: r["n"] for r in out.groupBy("mix_source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    for r in rows:  # within a budget by a document at most
        assert r["quota"] - longest <= used[r["source"]] <= r["quota"]
    assert out.select("doc_id", "text").distinct().exceptAll(awkward.select("doc_id", "text").distinct()).count() == 0
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixing_uses_every_document_and_meets_entropy(spark):
    rows = [(i, "a b c d", "big" if i % 4 else f"small{i % 8}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, repetition=1.25, block_tokens=50)
    assert out.select("doc_id").distinct().count() == 400
    by = Counter(r["source"] for r in out.collect())
    assert by["big"] == 300 and all(60 <= v <= 63 for s, v in by.items() if s != "big")
    plan = mixing.plan(mixing.count_tokens(docs), entropy=1.0, repetition=None)
    w = [r["weight"] for r in plan.sources.collect()]
    assert -sum(x * np.log(x) for x in w) == pytest.approx(1.0, abs=1e-4)


def test_quality_classifier(awkward, no_docs, spark):
    got = quality.classify(awkward).toPandas()
    assert len(got) == awkward.count() and got.score.between(0, 1).all()
    empty = got[got.votes == "." * len(quality.LABELLERS)]
    assert len(empty) and empty.keep.all()
    kept = quality.keep_good(awkward, quality.train(awkward))
    assert kept.schema == awkward.schema and kept.count() == got.keep.sum()
    assert quality.classify(no_docs).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rnd = np.random.default_rng(3)
    truth = rnd.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rnd.random(len(truth)) < a, truth, ~truth).astype(int) for a in right], axis=1)
    votes[rnd.random(votes.shape) < 0.3] = -1
    posterior, share, table = quality.estimate(Counter("".join(".-+"[v + 1] for v in row) for row in votes))
    assert share == pytest.approx(0.8, abs=0.03)
    for i, a in enumerate(right):
        assert table[1, i, 1] == pytest.approx(a, abs=0.04) and table[0, i, 0] == pytest.approx(a, abs=0.06)


def test_classifier_on_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"))
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (both.keep == (both.quality == 1)).mean() > 0.98
    assert both.keep[both.quality == 1].mean() > 0.99


def test_packing(awkward, no_docs):
    import tokenizers

    got = packing.pack(awkward, WORD, capacity=256).collect()
    whole = tokenizers.Tokenizer.from_file(WORD)
    want = Counter()
    for doc, text in pairs(awkward):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 256)):
            want[doc, k, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256
    assert len(filled) == -(-sum(r["length"] for r in got) // 256)
    assert packing.pack(no_docs, WORD).count() == 0


def test_bin_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 3: 2, 2: 4}
    plan = packing.plan_bins(counts, 10, 5000)
    used = Counter()
    for pattern, times in plan:
        assert sum(s * c for s, c in pattern) <= 10
        for s, c in pattern:
            used[s] += c * times
    assert used == counts and sum(t for _, t in plan) == -(-sum(s * c for s, c in counts.items()) // 10)
    left = np.bincount([7, 6, 6, 5, 4, 4], minlength=21)
    assert packing._best_fit(left, 7, 13) == [(6, 2)]  # wastes one
    assert packing.complete_bin(left, 7, 20, 5000) == [(5, 1), (4, 2)]  # wastes none


@pytest.mark.parametrize("times", [1, 2, 7, 1000])
def test_branch_and_bound_beats_the_fullest_fillings(times):
    """Best fit and the fullest filling per longest length both need 4 sequences where 3 are enough."""
    counts = dict.fromkeys((1100, 1090, 1080, 720, 700, 500, 448, 258, 248), times)
    plan, proven = packing.best_plan(counts)
    used = Counter()
    for pattern, n in plan:
        assert sum(s * c for s, c in pattern) <= 2048
        for s, c in pattern:
            used[s] += c * n
    assert used == counts and proven and sum(n for _, n in plan) == 3 * times


def test_plans_are_minimal_on_small_tables():
    import random

    def least(items, capacity):
        best = len(items)

        def rec(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
                rec(i + 1, [b + items[i] * (j == k) for j, b in enumerate(bins)])
            rec(i + 1, [*bins, items[i]])

        rec(0, [])
        return best

    rnd = random.Random(7)
    for trial in range(600):
        capacity = rnd.choice([20, 50, 100])
        items = sorted((rnd.randrange(capacity // 6, capacity * 2 // 3) for _ in range(rnd.randrange(1, 10))), reverse=True)
        plan, proven = packing.best_plan(Counter(items), capacity)
        assert proven and sum(n for _, n in plan) == least(items, capacity), (capacity, items)


def test_word_ids_forget_the_words_seen_once_and_keep_the_others():
    words = packing.WordIds(WORD, most=100)
    for i in range(20):
        batch = ["the lamp, the wattline. the " + " ".join(f"w{i}x{j}" for j in range(60))]
        assert words.encode(batch)[0].tolist() == words.tokenizer.encode(batch[0], add_special_tokens=False).ids
        assert len(words.slot) <= 100 + 64
    words._forget()  # what every text holds stays known through it
    assert set(words.slot) == {"", "the", "lamp,", "wattline."}


def test_a_worker_tokenizes_and_cuts_texts_in_small_parts(monkeypatch):
    import pyarrow as pa

    texts_ = ["ab " * 4000] * 200  # 2.4 MB
    got = []

    class Plan:
        def mapInArrow(self, run, schema):
            return run

    class Words:
        def encode(self, batch):
            got.append(sum(map(len, batch)))
            return [np.zeros(3, np.uint32) for _ in batch]

    monkeypatch.setattr(packing, "texts", lambda docs: Plan())
    monkeypatch.setattr(packing, "word_ids", lambda path, most: Words())
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts_)], names=["doc_id", "text"])
    rows = [r for out in packing.cut_pieces(None, WORD)([batch]) for r in out.column(0).to_pylist()]
    assert rows == list(range(200)) and max(got) <= packing.CHUNK

    spans = [None, [], [3, 9], [0, 3, 11_997, 12_000]] * 50
    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array([12_000] * 200), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "text", "n_chars", "cut"])
    out = list(suffix.cut_batches([batch], ["doc_id", "text", "n_chars"]))
    assert max(b.num_rows for b in out) * 12_000 <= suffix.CHUNK
    assert [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))] == [
        (i, t, len(t)) for i, s in enumerate(spans) for t in [suffix.kept_bytes(texts_[i].encode(), s).decode()]]


def test_word_ids_equal_the_tokenizer():
    words = packing.WordIds(WORD, most=50)
    odd = ["It's İstanbul <|endoftext|>. x<|startoftext|>,y ... é. ΣΣ.  ,. QÉ, don't. 12, a1.", "\x1c f. 'S. ''ll, '", "", " ", "\n\n", ".", ",", "A.",
           "ǅ.", "ﬁ,Å.", "ẞ, ŉ.", "µ. ª, ß. À.", "x" * 3000, " ".join(f"w{i}" for i in range(200))]
    for batch in (odd, odd[::-1], odd):
        for text, ids in zip(batch, words.encode(batch)):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_word_ids_need_the_whole_tokenizer_only_for_odd_words():
    words = packing.WordIds(WORD)
    whole, asked, merged = words.tokenizer, [], []

    class Model:
        def tokenize(self, unit):
            merged.append(unit)
            return whole.model.tokenize(unit)

    class Counting:
        model = Model()

        def encode_batch_fast(self, batch, **how):
            asked.extend(batch)
            return whole.encode_batch_fast(batch, **how)

    words.tokenizer = Counting()
    text = "Lamp.*** lamp%%% LAMP, É1lamp É--lamp12, ..lamp &lamp; lamp> don't <|endoftext|> ²x"
    for again in range(2):
        assert words.encode([text, "lamp"])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert asked == ["don't", "<|endoftext|>", "²x"]
    assert len(merged) == len(set(merged)) and merged.count("lamp") == 1


def test_short_words_seen_before_are_found_without_a_string(monkeypatch):
    asked = []

    class Asked(packing._Slots):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(packing, "_Slots", Asked)
    words = packing.WordIds(WORD)
    long = "x" * 17
    texts_ = [f"the  lamp\x00 lamp\n{'é' * 8} {long} ", "", f"{long} lamp {'y' * 16} {'y' * 15}", "\x00" * 16 + " " + "\x00" * 8]
    for again in range(3):
        asked.clear()
        for text, ids in zip(texts_, words.encode(texts_)):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked == [long, long]
    words._forget()
    assert words.encode(texts_)[0].tolist() == words.tokenizer.encode(texts_[0], add_special_tokens=False).ids

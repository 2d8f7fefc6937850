"""Temperature mixing of sources (operator 8).

Source token shares p are raised to an exponent a and normalised: w = p^a / sum p^a.
The exponent is bisected to meet a target entropy or a limit on repetition (a = 1
keeps the shares, a = 0 makes sources equal).  The weights become token quotas, and
each source fills its quota from permuted blocks of its documents (a block for every BLOCK_TOKENS tokens and documents): as many whole
passes as fit, each in a new order of blocks, then a last pass that ends where the
quota does.  Documents go to blocks by hash, and a hot source has more blocks, so
no source meets in one task.

The plan is two small tables, sources and block passes; any table of the same
documents is then mixed by joining it to the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import WORD, Scratch, numbered

BLOCK_TOKENS = 200_000
GRID, ROUNDS = 32, 6  # exponents tried in one pass over the sources, and passes


@dataclass
class Mix:
    exponent: float
    sources: DataFrame  # source, tokens, share, weight, quota, whole, rest, blocks
    passes: DataFrame  # source, block, pass, block_rank, at, cutoff


def source_key() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def block_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def order_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pass"), F.col("doc_id"))


def word_count() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def bisect_exponent(sources: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """The exponent in [0, 1] that meets the target, to 1 / GRID**ROUNDS, a grid of exponents per pass.

    ``entropy`` (nats): the largest exponent whose weights have at least that entropy.
    ``repetition``: the smallest exponent at which no source is repeated more than so
    many times as often as the least repeated one.  A target out of reach gives the
    nearest end.
    """
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        p = F.col("share")
        cols = []
        for i, a in enumerate(grid):
            if entropy is not None:
                z = F.sum(F.pow(p, F.lit(a)))
                cols.append((F.log(z) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z >= F.lit(entropy)).alias(f"g{i}"))
            else:
                cols.append((F.max(F.pow(p, F.lit(a - 1))) / F.min(F.pow(p, F.lit(a - 1))) <= F.lit(repetition)).alias(f"g{i}"))
        row = sources.where(p > 0).agg(*cols).first()
        good = [bool(row[f"g{i}"]) for i in range(GRID + 1)]
        if entropy is not None:  # entropy falls as the exponent rises
            k = max([i for i, g in enumerate(good) if g], default=0)
            lo, hi = grid[k], grid[min(k + 1, GRID)]
        else:
            k = min([i for i, g in enumerate(good) if g], default=GRID)
            lo, hi = grid[max(k - 1, 0)], grid[k]
    return lo if entropy is not None else hi


def plan(tokens: DataFrame, entropy: float | None = None, repetition: float | None = 1.25, budget: int | None = None,
         seed: int = 8, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """The mix of ``tokens`` (doc_id, source, n_tokens).

    ``budget``: tokens in all; None takes the least budget that uses every document
    at least once, so that nothing is lost.  A null source is the source "", one
    without tokens keeps its documents once, and equal rows are taken together.
    """
    spark = tokens.sparkSession
    keep = Scratch(spark, "mixing")
    t = tokens.select("doc_id", source_key().alias("source"), "n_tokens")
    counts = keep.table("counts", t.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    total = counts.select((F.sum("tokens")).cast("double")).scalar()
    shares = keep.table("shares", counts.withColumn("share", F.try_divide(F.col("tokens").cast("double"), total)))
    a = round(bisect_exponent(shares, entropy, repetition), 9)
    p = F.col("share")
    positive = shares.where(p > 0)
    z = positive.select(F.sum(F.pow(p, F.lit(a)))).scalar()
    weighed = shares.withColumn("weight", F.when(p > 0, F.pow(p, F.lit(a)) / z).otherwise(F.lit(0.0)))
    size = F.lit(float(budget)) if budget is not None else keep.table("weighed", weighed).where(p > 0).select(
        F.max(F.col("tokens") / F.col("weight"))).scalar()
    quota = F.coalesce(F.round(F.col("weight") * size).cast("long"), F.lit(0))
    empty = F.col("tokens") == 0
    sources = keep.table("sources", weighed.withColumn("quota", quota).select(
        "source", "tokens", "share", "weight", "quota",
        F.when(empty, 1).otherwise(F.floor(F.try_divide(F.col("quota"), F.col("tokens")))).cast("long").alias("whole"),
        F.when(empty, 0).otherwise(F.try_mod(F.col("quota"), F.col("tokens"))).cast("long").alias("rest"),
        F.greatest(F.lit(1), F.ceil((F.col("tokens") + F.col("documents")) / block_tokens)).cast("int").alias("blocks")))

    placed = t.join(sources.select("source", "blocks", "whole", "rest"), "source").withColumn(
        "block", F.pmod(block_key(seed), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    runs = blocks.join(sources.select("source", "tokens", "quota", "whole", "rest"), "source").where(last >= 0).withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # the order of a pass's blocks and the tokens before each, by ranges: a source of any number of blocks is no single task
    runs = numbered(keep, "ordered", runs.withColumn("_o", F.xxhash64(F.lit(seed + 1), "pass", "block")), ["_o", "block"], "source", "pass", add="size")
    runs = runs.withColumnRenamed("pos", "block_rank").drop("_o", "n")
    partial = F.col("pass") == F.col("whole")
    runs = keep.table("runs", runs.withColumn("room", F.when(partial, F.col("rest") - F.col("before")))
                      .where(F.col("room").isNull() | (F.col("room") > 0) | ((F.col("size") == 0) & (F.col("room") >= 0))))
    # the block in which a quota ends: its documents in the pass's order, up to the first that does not fit
    ends = runs.where(F.col("room") < F.col("size")).select("source", "block", "pass", "room")
    inside = placed.join(ends, ["source", "block"]).groupBy("source", "block", "pass", "room", order_key(seed).alias("key")).agg(
        F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source", "block", "pass").orderBy("key")
    cut = (inside.withColumn("filled", F.sum("n").over(upto)).where(F.col("filled") > F.col("room"))
           .groupBy("source", "block", "pass").agg(F.min("key").alias("cutoff")))
    at = F.try_divide((F.col("pass") * F.col("tokens") + F.col("before")).cast("double"), F.col("quota").cast("double"))
    passes = keep.table("passes", runs.join(cut, ["source", "block", "pass"], "left").select(
        "source", "block", "pass", "block_rank", F.coalesce(at, F.lit(0.0)).alias("at"), "cutoff"))
    keep.drop("counts", "shares", "weighed", "ordered", "runs")
    return Mix(a, sources, passes)


def apply(docs: DataFrame, mix: Mix, seed: int = 8) -> DataFrame:
    """``docs`` once per pass that takes them, with the columns of the plan prefixed ``mix_``."""
    s = mix.sources.select(F.col("source").alias("mix_source"), F.col("blocks").alias("mix_blocks"), F.col("weight").alias("mix_weight"))
    b = mix.passes.select(F.col("source").alias("mix_source"), F.col("block").alias("mix_block"), F.col("pass").alias("mix_pass"),
                          F.col("block_rank").alias("mix_block_rank"), F.col("at").alias("mix_at"), F.col("cutoff").alias("mix_cutoff"))
    d = docs.withColumn("mix_source", source_key()).join(s, "mix_source").withColumn(
        "mix_block", F.pmod(block_key(seed), F.col("mix_blocks")).cast("int")).drop("mix_blocks")
    key = F.xxhash64(F.lit(seed), F.col("mix_pass"), F.col("doc_id"))
    return d.join(b, ["mix_source", "mix_block"]).where(F.col("mix_cutoff").isNull() | (key < F.col("mix_cutoff"))).drop("mix_cutoff")


def repeat(docs: DataFrame, mix: Mix, seed: int = 8) -> DataFrame:
    """``docs``, with its own columns whatever their names, once per pass that takes them."""
    fields = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    row = F.struct(*[F.col(f).alias(f"c{i}") for i, f in enumerate(fields)]).alias("row")
    return apply(docs.select("doc_id", "source", row), mix, seed).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def count_tokens(docs: DataFrame, name: str = "mixing-tokens") -> DataFrame:
    """(doc_id, source, n_tokens), written: the words of whole texts, null text empty."""
    return Scratch(docs.sparkSession, name).table("tokens", docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("n_tokens")))


def mix_sources(docs: DataFrame, **target) -> DataFrame:
    """doc_id, source, n_tokens, weight, pass, block, block_rank, at: a row per document and pass that takes it.

    Sorted by ``at`` (the part of the source's quota that comes before the block), then
    block and doc_id, the rows interleave the sources by weight at every point.
    """
    tokens = count_tokens(docs)
    out = apply(tokens, plan(tokens, **target))
    return out.select("doc_id", F.col("mix_source").alias("source"), "n_tokens", F.col("mix_weight").alias("weight"),
                      F.col("mix_pass").cast("int").alias("pass"), F.col("mix_block").alias("block"),
                      F.col("mix_block_rank").cast("int").alias("block_rank"), F.col("mix_at").alias("at"))

"""Merkle manifest of a table of documents (operator 11).

A leaf is the digest of a row's fields, each written as ``-`` if null, else as its
length in UTF-8 bytes, a colon and its value.  The leaves of a language, in rising
doc_id, are reduced by pairs to a subroot, and the subroots, by language, to the root.
A proof is the list of siblings from a leaf to the root; folding a leaf with it gives
the root again if the leaf is unchanged.

Cogrouped subtree exchange: BLOCK consecutive leaves are a superblock.  On the way up
a group reduces a superblock to its root, and the roots are the next tier's nodes, until
a language has one node.  On the way down each superblock is cogrouped with the one row
of outer nodes that it needs (the siblings above its root); the group finishes the local
reduction, joins the local siblings to the outer ones, and folds.  No group is larger
than a superblock, whatever the size of a language.

Positions come from a range partitioning by (language, doc_id, leaf): the row's number in
its partition plus the counts of the partitions before, so a hot language is spread too.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, numbered

BLOCK_BITS = 12  # a superblock has 4096 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "doc_id long, leaf string, subroot string, root string, folded_root string, proof array<string>, proof_sha256 string"


def digest(*values: str) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(**instead: Column) -> Column:
    """The leaf of a row, with other values for some of its fields."""
    return F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered() -> Column:
    """Rows whose unsigned crc32 of the decimal doc_id is a multiple of 7; none with a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def rounds(n: int) -> int:
    """Rounds of pairing that leave one of ``n`` nodes."""
    return max(n - 1, 0).bit_length()


def reduce_levels(nodes: list[str], times: int) -> list[list[str]]:
    """The nodes and what each of ``times`` rounds leaves of them; a last node without a partner is hashed alone."""
    levels = [nodes]
    for _ in range(times):
        last = levels[-1]
        levels.append([digest(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """A step per round above node ``at``: L or R and the sibling on that side, or empty where there is none."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append(("L" if other < at else "R") + level[other] if other < len(level) else "")
        at >>= 1
    return steps


def fold(leaf: str, steps: list[str]) -> str:
    for s in steps:
        leaf = digest(leaf) if not s else digest(s[1:], leaf) if s[0] == "L" else digest(leaf, s[1:])
    return leaf


def _local(nodes: pd.DataFrame, bits: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's nodes in order, and the levels of its reduction (all rounds only where it is not the whole tree)."""
    nodes = nodes.sort_values("pos")
    return nodes, reduce_levels(nodes["node"].tolist(), min(bits, rounds(int(nodes["n"].iloc[0]))))


class Tree:
    """The tiers of one set of trees (a tree per ``grp``), from ``nodes`` (grp, pos, n, node and others) up to their roots."""

    def __init__(self, keep: Scratch, name: str, nodes: DataFrame, bits: int):
        self.keep, self.name, self.bits = keep, name, bits
        self.tiers = [keep.table(f"{name}-0", nodes)]
        most = None
        while most is None or most > 1:
            tier = keep.table(f"{name}-{len(self.tiers)}", self._up(self.tiers[-1]))
            self.tiers.append(tier)
            most = tier.agg(F.max("n")).first()[0] or 0  # the largest tree's number of nodes

    def _block(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.shiftright("pos", self.bits))

    def _up(self, nodes: DataFrame) -> DataFrame:
        bits = self.bits

        def superblock(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            _, levels = _local(group, bits)
            n = -(-int(group["n"].iloc[0]) // (1 << bits))
            return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [n], "node": [levels[-1][0]]})

        return self._block(nodes.select("grp", "pos", "n", "node")).groupBy("grp", "block").applyInPandas(
            superblock, "grp string, pos long, n long, node string")

    def roots(self) -> DataFrame:
        return self.tiers[-1].select("grp", "node")

    def down(self, outer: DataFrame, tier: int, finish, schema: str) -> DataFrame:
        """``finish(nodes, levels, outer row)`` per superblock of a tier, cogrouped with its outer nodes (grp, pos, steps, subroot, root)."""
        bits, nodes = self.bits, self._block(self.tiers[tier])
        above = outer.withColumnRenamed("pos", "block")

        def run(group: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
            return finish(*_local(group, bits), out.iloc[0])

        return nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(run, schema)

    def outer(self, outer: DataFrame) -> DataFrame:
        """The outer nodes of tier 1 (the superblocks of the leaves) from those of the roots."""
        schema = "grp string, pos long, steps array<string>, subroot string, root string"

        def join(nodes: pd.DataFrame, levels, above) -> pd.DataFrame:
            return pd.DataFrame({"grp": nodes["grp"], "pos": nodes["pos"], "subroot": above["subroot"], "root": above["root"],
                                 "steps": [siblings(levels, i) + list(above["steps"]) for i in range(len(nodes))]})

        for tier in range(len(self.tiers) - 2, 0, -1):
            outer = self.keep.table(f"{self.name}-outer-{tier}", self.down(outer, tier, join, schema))
        return outer


def manifest(docs: DataFrame, changed: Column | None = None, bits: int = BLOCK_BITS, proofs: bool = True) -> DataFrame:
    """A row per document: its leaf, its language's subroot, the root, the proof's steps and their digest, and the folded root.

    ``changed``: the leaf that is folded instead of the row's own (see ``leaf_of``); with
    ``proofs`` False the steps are null and only their digest is given.

    Null fields are ``-``; a null language comes before all others and a null doc_id
    before all others of its language; rows of equal doc_id go by their leaf, and equal
    rows are leaves of their own; texts of any length count whole; an empty table gives
    no rows; columns beyond the five fields are not read.
    """
    keep = Scratch(docs.sparkSession, "merkle")
    d = docs.select(*[F.col(c).cast("string" if c in ("source", "lang", "text") else "long").alias(c) for c in FIELDS])
    group = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    # hashed once; the text goes no further
    hashed = keep.table("hashed", d.select("doc_id", group.alias("grp"), leaf_of().alias("node"), (leaf_of() if changed is None else changed).alias("given")))
    tree = Tree(keep, "leaves", numbered(keep, "placed", hashed, ["doc_id", "node"], "grp"), bits)
    subroots = tree.roots().select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    keep.drop("hashed", "placed")
    top = Tree(keep, "subroots", numbered(keep, "named", subroots, ["name"], "grp"), bits)
    root = top.roots().select("grp", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("steps"),
                              F.col("node").alias("subroot"), F.col("node").alias("root"))

    def of_subroots(nodes: pd.DataFrame, levels, above) -> pd.DataFrame:
        return pd.DataFrame({"grp": nodes["name"], "pos": 0, "subroot": nodes["node"], "root": above["root"],
                             "steps": [siblings(levels, i) + list(above["steps"]) for i in range(len(nodes))]})

    outer = keep.table("outer", top.down(top.outer(root), 0, of_subroots, "grp string, pos long, steps array<string>, subroot string, root string"))

    def of_leaves(nodes: pd.DataFrame, levels, above) -> pd.DataFrame:
        beyond = list(above["steps"])
        steps = [siblings(levels, i) + beyond for i in range(len(nodes))]
        return pd.DataFrame({"doc_id": nodes["doc_id"].astype("Int64"), "leaf": nodes["node"], "subroot": above["subroot"], "root": above["root"],
                             "folded_root": [fold(g, s) for g, s in zip(nodes["given"], steps)],
                             "proof": steps if proofs else None, "proof_sha256": [digest(*[x[1:] for x in s]) for s in steps]})

    return tree.down(tree.outer(outer), 0, of_leaves, PROOF)


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of the untouched rows, and what folds from the rows of which some gain a character in n_chars."""
    more = F.when(tampered(), F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    out = manifest(docs, leaf_of(n_chars=more), proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


SQL = f"""WITH RECURSIVE crc AS (
  SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, grp, leaf, given, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM (SELECT doc_id, grp, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS given FROM crc) q),
nodes AS (
  SELECT grp, 0 AS lvl, pos AS idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, idx // 2, n),
subroots AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos AS idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (
  SELECT l.grp, l.pos, v.lvl, CASE WHEN s.h IS NULL THEN '' WHEN (l.pos >> v.lvl) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM leaves l JOIN (SELECT DISTINCT grp, lvl FROM nodes WHERE n > 1) v ON v.grp = l.grp
  LEFT JOIN nodes s ON s.grp = l.grp AND s.lvl = v.lvl AND s.idx = xor(l.pos >> v.lvl, 1)
  UNION ALL
  SELECT l.grp, l.pos, 1000 + v.lvl, CASE WHEN s.h IS NULL THEN '' WHEN (r.pos >> v.lvl) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END
  FROM leaves l JOIN subroots r ON r.grp = l.grp CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) v
  LEFT JOIN top s ON s.lvl = v.lvl AND s.idx = xor(r.pos >> v.lvl, 1)),
proofs AS (SELECT grp, pos, list(step ORDER BY lvl) AS steps FROM steps GROUP BY grp, pos),
folded AS (
  SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.steps, []) AS steps,
    list_reduce(list_prepend(l.given, coalesce(p.steps, [])),
      lambda a, s: CASE WHEN s = '' THEN sha256(a) WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM leaves l JOIN subroots r ON r.grp = l.grp LEFT JOIN proofs p ON p.grp = l.grp AND p.pos = l.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded"""

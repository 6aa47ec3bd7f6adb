"""Merkle manifest of a table: a digest for each row, for each group of rows and for the whole, with a proof for each row.

A row's leaf is the digest of its fields, each as its length in UTF-8 bytes, a colon and its value, or `-` where it is null. The leaves of a
group ascend; while there are several nodes, every FANOUT consecutive ones become the digest of their digests. The groups'
roots, ordered by group, likewise give the root of the manifest.

Levels collapse in blocks: a block is an array of up to FANOUT ** LEVELS consecutive nodes, collapsed level by level with SQL functions
(sequence, transform, slice, aggregate). Its root is one node of the next round, which does the same with the roots of blocks, until each group
has one node left; every round is a few thousand times smaller than the one before. So no task holds more than a block, however many rows a group has.

Null fields, and a null group, are values like others; nulls come first in order. Rows with equal keys are ordered by their leaves, and equal rows have equal
leaves in places of their own. Texts are digested whole. An empty table gives none. Extra columns don't enter a leaf and aren't returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm.ordering import placed
from quartier.llm.store import written

FANOUT = 8
#: Levels that one block collapses, so blocks have 4,096 nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    def one(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return digest(F.concat(*[one(c) for c in fields]))


def joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(""), lambda text, node: F.concat(text, node))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(joined(F.slice(level, i * FANOUT + 1, FANOUT))))


def _depth(n: Column, most: int) -> Column:
    """Levels that n nodes need to become one, at most so many."""
    return sum(((n > FANOUT**k).cast("int") for k in range(most)), F.lit(0))


def _blocks(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """Blocks of nodes (g, pos, n, node and others): `items` in order, and `levels`, the digests level by level from the nodes to the block's root."""
    rest = [c for c in nodes.columns if c not in ("g", "n")]
    block = F.floor(F.col("pos") / FANOUT**levels).cast("long")
    own = nodes.groupBy("g", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("items"))
    steps = F.slice(F.array(*[F.lit(k) for k in range(levels)]), F.lit(1), _depth(F.col("n"), levels))
    base = F.array(F.transform("items", lambda x: x["node"]))
    grown = F.aggregate(steps, base, lambda done, k: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    return written(own.withColumn("levels", grown), name)


def _runs(levels: Column, i: Column, most: int) -> Column:
    """From the block's node i upwards: the run that each node stands in, and at which place."""
    steps = [F.struct(F.slice(F.get(levels, F.lit(k)), F.floor(i / FANOUT ** (k + 1)).cast("int") * FANOUT + 1, FANOUT).alias("run"), (F.floor(i / FANOUT**k) % FANOUT).cast("int").alias("at")) for k in range(most)]
    return F.slice(F.array(*steps), F.lit(1), F.size(levels) - 1)


def _grown(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """Blocks of the nodes with `upper`, the runs above the block, and `top`, the group's root."""
    blocks = _blocks(nodes, levels, name)
    roots = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / FANOUT**levels).cast("long").alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
    none = F.array().cast("array<struct<run:array<string>,at:int>>")
    if roots.filter("n > 1").isEmpty():
        return blocks.withColumns({"upper": none, "top": F.element_at(F.element_at("levels", -1), 1)})
    return blocks.join(paths(roots, levels, name).withColumnRenamed("pos", "block"), ["g", "block"]).withColumnRenamed("path", "upper")


def paths(nodes: DataFrame, levels: int = LEVELS, name: str = "merkle-blocks") -> DataFrame:
    """g, pos, `path` and `top` of every node (g, pos from 0, n nodes in g, node): the runs from it to its group's root, and that root."""
    each = F.transform("items", lambda x, i: F.struct(x["pos"].alias("pos"), F.concat(_runs(F.col("levels"), i, levels), F.col("upper")).alias("path")))
    return _grown(nodes, levels, name).select("g", "top", F.explode(each).alias("x")).select("g", "x.pos", "x.path", "top")


def siblings(path: Column) -> Column:
    """Digests of the siblings, level by level upwards, left to right, as one text."""
    return joined(F.transform(path, lambda p: F.concat(joined(F.slice(p["run"], F.lit(1), p["at"])), joined(F.slice(p["run"], p["at"] + 2, FANOUT)))))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, node, lambda own, p: digest(F.concat(joined(F.slice(p["run"], F.lit(1), p["at"])), own, joined(F.slice(p["run"], p["at"] + 2, FANOUT)))))


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For leaves (group, key, leaf, claimed): key, leaf, subroot, root, the digest of its proof, the root that the claimed leaf folds to, and whether it is the root."""
    # group names become texts that keep their order, the null before all others
    own = written(leaves.select(F.coalesce(F.concat(F.lit("+"), F.col("group").cast("string")), F.lit("")).alias("g"), "key", F.col("leaf").alias("node"), "claimed"), "merkle-leaves")
    blocks = _grown(placed(own, "g", ("key", "node"), "merkle-ordered"), levels, "merkle-blocks")
    subroots = written(blocks.filter("block = 0").select("g", "top"), "merkle-subroots")
    over = placed(subroots.select(F.lit("").alias("all"), "g", F.col("top").alias("node")), "all", ("g",), "merkle-groups")
    above = paths(over.select(F.col("all").alias("g"), "pos", "n", "node"), levels, "merkle-top").select("pos", F.col("path").alias("over"), F.col("top").alias("root"))
    groups = over.select("g", "pos").join(above, "pos").drop("pos")

    def one(x: Column, i: Column) -> Column:
        path = F.concat(_runs(F.col("levels"), i, levels), F.col("upper"), F.col("over"))
        return F.struct(x["key"].alias("key"), x["node"].alias("leaf"), digest(siblings(path)).alias("proof_sha256"), folded(x["claimed"], path).alias("folded_root"))

    each = blocks.join(groups, "g").select("top", "root", F.explode(F.transform("items", one)).alias("x"))
    return each.select("x.key", "x.leaf", F.col("top").alias("subroot"), "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by lang; where 3 divides the crc32 of the doc_id, the claimed leaf is that of the text in lower case (A-Z)."""
    fields = [F.col(c) for c in FIELDS]
    lowered = [*fields[:-1], F.translate("text", UPPER, LOWER)]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf(*fields).alias("leaf"), F.when(tampered, leaf(*lowered)).otherwise(leaf(*fields)).alias("claimed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return manifest(document_leaves(docs)).withColumnRenamed("key", "doc_id")


#: crc32 of the decimal digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], "{0}")) + ")"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_LEAF.format("text")} AS leaf,
         {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered, coalesce({_CRC.format("doc_id::VARCHAR")} % 3 = 0, false) AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS lvl, g, pos, n, leaf AS h FROM p
      UNION ALL SELECT lvl + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, g, pos // 8, n),
s AS (SELECT g, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM s
      UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
k AS (SELECT g, lvl, pos // 8 AS up, list(h ORDER BY pos) AS run FROM t WHERE n > 1 GROUP BY g, lvl, pos // 8
      UNION ALL SELECT s.g, s.depth + u.lvl, s.pos // (8 ** (u.lvl + 1))::BIGINT, list(u.h ORDER BY u.pos) FROM s JOIN u ON u.n > 1 AND u.pos // 8 = s.pos // (8 ** (u.lvl + 1))::BIGINT GROUP BY ALL),
c AS (SELECT p.doc_id, p.g, p.pos AS own, s.pos AS above, s.depth, 0 AS lvl, CASE WHEN tampered THEN lowered ELSE leaf END AS node, '' AS proof, leaf, subroot FROM p JOIN s USING (g)
      UNION ALL
      SELECT c.doc_id, c.g, c.own, c.above, c.depth, c.lvl + 1, sha256(array_to_string(list_concat(run[1:slot], [node], run[slot + 2:8]), '')),
             proof || array_to_string(list_concat(run[1:slot], run[slot + 2:8]), ''), leaf, subroot
      FROM (SELECT *, CASE WHEN lvl < depth THEN own // (8 ** lvl)::BIGINT ELSE above // (8 ** (lvl - depth))::BIGINT END AS i, i % 8 AS slot FROM c) c
      JOIN k ON k.g = c.g AND k.lvl = c.lvl AND k.up = i // 8)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
FROM c, (SELECT h, lvl FROM u WHERE n = 1) r WHERE c.lvl = c.depth + r.lvl
"""

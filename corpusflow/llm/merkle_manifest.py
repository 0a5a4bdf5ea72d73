"""Merkle manifest of a dataset: persisted every few levels, proofs by recomputing the rest.

A manifest is a forest of trees over ordered leaves. Only every third level is written; a
written node stands for an aligned subtree of 8^3 nodes of the level written before. A proof
descends from the root: each subtree's missing inner nodes are made again from its stored
descendants, the siblings along each path are emitted, and the inner nodes are forgotten.
Subtrees are bounded, so a tree of any size, or one that holds most of all leaves, is spread
over as many tasks as it has subtrees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.staging import free_name, parts_for, staged

FAN_OUT = 8
#: Levels from one stored level to the next.
LEVELS_APART = 3
#: Leaves that one sorted part holds on average.
PART_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def leaf_of(values: list[Column]) -> Column:
    """Digest of a record: each value as its UTF-8 byte count, a colon and the value; null is a dash."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*parts))


@dataclass
class Forest:
    """Stored levels (tree, at, node; the first also `carry`) and trees (tree, depth, root), one row per tree."""

    levels: list[DataFrame]
    trees: DataFrame


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` (with column tree) with `at`: their place in their tree, counted without one task per tree.

    Rows are sorted in ranges of (tree, order, place in the table), so neither a large tree nor many
    equal rows meet in one part; a place is the row's number in its part plus the tree's rows in
    earlier parts.
    """
    parts = parts_for(rows.count(), PART_ROWS)
    kept = rows.columns
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(parts, F.col("tree"), *order, F.col("_row")).sortWithinPartitions("tree", *order, "_row")
    ranked = staged(
        ranged.select(*kept, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), "merkle-order",
    )
    runs = ranked.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranked.join(starts, ["tree", "_part"]).select(*kept, (F.col("_seq") - F.col("_first") + F.col("_before")).alias("at"))


def _up(nodes: str) -> Column:
    """The next level of an array of nodes: every run of FAN_OUT becomes the digest of its concatenation."""
    return F.expr(
        f"transform(sequence(0, (size({nodes}) - 1) div {FAN_OUT}),"
        f" i -> sha2(array_join(slice({nodes}, cast(i as int) * {FAN_OUT} + 1, {FAN_OUT}), ''), 256))"
    )


def _blocks(level: DataFrame, trees: DataFrame, done: int, *more: str) -> DataFrame:
    """One row per aligned subtree: tree, block, steps (levels to go up) and its levels l0, l1, ..., each a bounded array."""
    width = FAN_OUT**LEVELS_APART
    blocks = level.groupBy("tree", F.expr(f"at div {width}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "node", *more))).alias("rows"),
    )
    steps = F.least(F.lit(LEVELS_APART), F.col("depth") - done).alias("steps")
    out = blocks.join(trees.select("tree", "depth"), "tree").select("tree", "block", steps, "rows", F.expr("rows.node").alias("l0"))
    for k in range(1, LEVELS_APART + 1):
        out = out.withColumn(f"l{k}", _up(f"l{k - 1}"))
    return out


def build_forest(nodes: DataFrame) -> Forest:
    """The forest over `nodes` (tree, at, node, carry): level 0 and every third level above it are written.

    A tree of n leaves has as many levels above them as FAN_OUT must be multiplied to reach n; a
    lone leaf is its own root. No leaves: no trees.
    """
    level = staged(nodes, "merkle-level")
    powers = [FAN_OUT**i for i in range(21) if FAN_OUT**i < 2**62]
    depth = sum((F.col("n") > p).cast("int") for p in powers)
    sizes = staged(level.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select("tree", depth.alias("depth")), "merkle-depth")
    deepest = sizes.agg(F.max("depth")).first()[0]
    levels, roots, done = [level], None, 0
    while deepest is not None:
        blocks = _blocks(levels[-1], sizes, done)
        tops = F.array(*[F.element_at(f"l{k}", 1) for k in range(LEVELS_APART + 1)])
        done += LEVELS_APART
        above = staged(
            blocks.select("tree", F.col("block").alias("at"), F.element_at(tops, F.col("steps") + 1).alias("node")).join(sizes, "tree"),
            "merkle-level",
        )
        finished = above.where(F.col("depth") <= done).select("tree", "depth", F.col("node").alias("root"))
        roots = finished if roots is None else roots.unionByName(finished)
        if deepest <= done:
            break
        levels.append(above.where(F.col("depth") > done).drop("depth"))
    trees = roots if roots is not None else sizes.withColumn("root", F.lit(None).cast("string"))
    return Forest(levels, staged(trees, "merkle-trees"))


def _siblings(steps: int) -> str:
    """Per level inside a block: the other nodes of the run that holds the ancestor of place i."""
    runs = []
    for k in range(steps):
        own = f"cast(i div {FAN_OUT**k} as int)"
        run = f"slice(l{k}, {own} div {FAN_OUT} * {FAN_OUT} + 1, {FAN_OUT})"
        runs.append(f"filter({run}, (x, j) -> j != {own} % {FAN_OUT})")
    return f"array({', '.join(runs)})"


def extract_proofs(forest: Forest, upper: DataFrame) -> DataFrame:
    """One row per leaf: tree, at, node, carry, siblings (a list per level, from the leaf up), places and `above`.

    places holds the leaf's or its ancestor's place in its run of each level. `upper` (tree, siblings,
    places, above) continues the proofs above the roots; `above` is any struct handed down. Blocks meet
    the proof of their top node by (tree, block): no key holds more than one block.
    """
    proofs = None
    for i in reversed(range(len(forest.levels))):
        done = i * LEVELS_APART
        ends = forest.trees.where((F.col("depth") > done) | F.lit(i == 0)).where(F.col("depth") <= done + LEVELS_APART)
        entering = upper.join(ends.select("tree"), "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "siblings", "places", "above")
        if proofs is not None:
            entering = entering.unionByName(proofs.select("tree", F.col("at").alias("block"), "siblings", "places", "above"))
        leaves = i == 0
        blocks = _blocks(forest.levels[i], forest.trees, done, *(["carry"] if leaves else []))
        inner = F.expr(
            "transform(rows, (r, i) -> struct(r.at as at, r.node as node"
            + (", r.carry as carry" if leaves else "")
            + f", slice({_siblings(LEVELS_APART)}, 1, steps) as own"
            + f", slice(array({', '.join(f'cast(i div {FAN_OUT**k} % {FAN_OUT} as int)' for k in range(LEVELS_APART))}), 1, steps) as own_places))"
        )
        paths = blocks.select("tree", "block", F.explode(inner).alias("p")).join(entering, ["tree", "block"])
        proofs = paths.select(
            "tree", "p.at", "p.node", *(["p.carry"] if leaves else []),
            F.concat("p.own", "siblings").alias("siblings"), F.concat("p.own_places", "places").alias("places"), "above",
        )
        if not leaves:
            proofs = staged(proofs, "merkle-proofs")
    return proofs


def fold(node: Column, siblings: Column, places: Column) -> Column:
    """The root that `node` leads to with these siblings and places."""

    def climb(below: Column, run: Column) -> Column:
        place, others = run["place"], run["others"]
        left = F.array_join(F.slice(others, F.lit(1), place), "")
        right = F.array_join(F.slice(others, place + 1, F.lit(FAN_OUT)), "")
        return digest(F.concat(left, below, right))

    return F.aggregate(F.arrays_zip(siblings.alias("others"), places.alias("place")), node, climb)


def _no_proof(above: Column) -> list[Column]:
    return [
        F.array().cast("array<array<string>>").alias("siblings"), F.array().cast("array<int>").alias("places"), above.alias("above"),
    ]


def document_proofs(docs: DataFrame, carry: dict[str, Column] | None = None, fields=FIELDS, tree_col: str = "lang", order_col: str = "doc_id") -> DataFrame:
    """One row per document: the order column, leaf, subroot, root, siblings and places of its proof, and `carry`'s columns.

    A tree per value of `tree_col` (null is a value, the first) over its documents by `order_col` (null
    first), then a tree over these trees' roots. Documents of one id are ordered by their leaves, so
    repeated rows have a leaf each and the root is the same for any order of the input; equal leaves are
    interchangeable. Texts are hashed where they are read and never shuffled, however long. Other columns of the input play no
    part, so their names can't clash; names in `carry` that are result columns get a "_" before. No
    documents: no rows.
    """
    carried = dict(carry or {})
    key = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    leaves = staged(docs.select(
        key.alias("tree"), F.col(order_col).alias("key"), leaf_of([F.col(f) for f in fields]).alias("node"),
        F.struct(F.lit(None).cast("int").alias("_none"), *[c.alias(n) for n, c in carried.items()]).alias("carry"),
    ), "merkle-leaves")
    numbered = _numbered(leaves, [F.col("key"), F.col("node")])
    forest = build_forest(numbered.select("tree", "at", "node", F.struct("key", F.col("carry").alias("own")).alias("carry")))

    subroots = forest.trees.select(F.lit("").alias("tree"), F.col("root").alias("node"), F.col("tree").alias("key"))
    top = build_forest(
        _numbered(subroots, [F.col("key")]).select("tree", "at", "node", F.struct("key").alias("carry")),
    )
    crown = top.trees.select("tree", *_no_proof(F.struct(F.col("root"))))
    upper = staged(extract_proofs(top, crown).select(
        F.col("carry.key").alias("tree"), "siblings", "places", F.struct(F.col("node").alias("subroot"), F.col("above.root").alias("root")).alias("above"),
    ), "merkle-upper")
    proofs = extract_proofs(forest, upper)
    out = proofs.select(
        F.col("carry.key").alias(order_col), F.col("node").alias("leaf"), "above.subroot", "above.root", "siblings", "places", "carry",
    )
    for name in carried:
        out = out.withColumn(free_name(out, name), F.col("carry.own")[name])
    return out.drop("carry")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = [F.translate(f, _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS]
    proofs = document_proofs(docs, {"tampered": F.when(changed, leaf_of(lowered))})
    judged = F.coalesce("tampered", "leaf")
    made = proofs.select(
        "doc_id", "leaf", "subroot", "root", digest(F.array_join(F.flatten("siblings"), "")).alias("proof_sha256"),
        fold(judged, F.col("siblings"), F.col("places")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 is written out bit by bit (reflected polynomial 0xEDB88320).
ORACLE_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY spot) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))
  FROM levels WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, max(level) AS depth, arg_max(nodes, level)[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot
  FROM levels GROUP BY lang),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY spot) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))
  FROM tops WHERE len(nodes) > 1),
root AS (SELECT arg_max(nodes, level)[1] AS root FROM tops),
steps AS (
  SELECT s.lang, l.level AS step, l.level AS level, l.nodes, NULL::BIGINT AS top FROM subroots s JOIN levels l ON s.lang IS NOT DISTINCT FROM l.lang AND l.level < s.depth
  UNION ALL
  SELECT s.lang, s.depth + t.level, t.level, t.nodes, s.spot FROM subroots s, tops t WHERE len(t.nodes) > 1),
paths AS (
  SELECT p.doc_id, p.lang, p.leaf, step, coalesce(top, p.spot) // (8 ** level)::BIGINT AS own, nodes
  FROM placed p JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang),
runs AS (
  SELECT doc_id, lang, leaf, step, array_to_string(nodes[own // 8 * 8 + 1:own], '') AS before,
    array_to_string(nodes[own + 2:own // 8 * 8 + 8], '') AS after FROM paths),
proofs AS (SELECT doc_id, lang, leaf, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM runs GROUP BY ALL),
folds AS (
  SELECT doc_id, lang, leaf, 0 AS step, coalesce(tampered, leaf) AS node FROM placed
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.step + 1, sha256(r.before || f.node || r.after)
  FROM folds f JOIN runs r ON f.doc_id IS NOT DISTINCT FROM r.doc_id AND f.lang IS NOT DISTINCT FROM r.lang AND f.leaf = r.leaf AND f.step = r.step),
ends AS (SELECT doc_id, lang, leaf, arg_max(node, step) AS folded_root FROM folds GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.subroot, root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN ends e ON p.doc_id IS NOT DISTINCT FROM e.doc_id AND p.lang IS NOT DISTINCT FROM e.lang AND p.leaf = e.leaf
  LEFT JOIN proofs x ON p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.lang IS NOT DISTINCT FROM x.lang AND p.leaf = x.leaf, root
"""

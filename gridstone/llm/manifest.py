"""Merkle manifest of a dataset: leaves by group, subroots, one root, and a proof for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.tables import written

#: Levels that one block of nodes climbs before block roots meet in the next tier; a window holds 2 ** LEVELS rows at most.
LEVELS = 10
#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: monotonically_increasing_id holds the partition above so many bits and the row in it below.
ROW_BITS = 33
PATH = "array<struct<slot:int,sibling:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, their place in the order of their group from 0, and n, the group's rows.

    One range exchange over (group, order), so that a group of any size is
    split; numbers inside ranges are fixed by writing, and the counts of
    (group, range) pairs give each range's first place.
    """
    keys = [group, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = written(ranged.withColumn("__gs_at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("__gs_at", ROW_BITS), F.col("__gs_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = fixed.withColumn("__gs_part", part).withColumn("__gs_row", row)
    whole = Window.partitionBy(group)
    before = whole.orderBy("__gs_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy(group, "__gs_part").agg(F.count("*").alias("__gs_n"), F.min("__gs_row").alias("__gs_first"))
    start = F.coalesce(F.sum("__gs_n").over(before), F.lit(0).cast("bigint")) - F.col("__gs_first")
    spans = spans.select(group, "__gs_part", start.alias("__gs_start"), F.sum("__gs_n").over(whole).alias("n"))
    joined = placed.join(spans, [group, "__gs_part"])
    return joined.withColumn("idx", F.col("__gs_row") + F.col("__gs_start")).select(*rows.columns, "idx", "n")


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes with node_0 .. node_levels and sibling_0 .. in blocks of 2 ** levels.

    All of a block's levels share one window and one sort. A level's node
    stands on the row of its first leaf, so its neighbours lie at the fixed
    offsets of the level: lag and lead, masked by the node's slot in its run
    and by whether the run has a second node. First children hash the parent;
    a run of one is hashed too while its group has several nodes.
    """
    out = nodes.selectExpr("*", f"shiftright(idx, {levels}) AS block", "node AS node_0")
    for k in range(levels):
        gap = 1 << k
        near = lambda way: f"{way}(node_{k}, {gap}) OVER (PARTITION BY g, block ORDER BY idx)"  # noqa: B023, E731
        second, full, stands, active = f"shiftright(idx, {k}) % 2 = 1", f"idx + {gap} < n", f"idx % {gap} = 0", f"n > {gap}"
        out = out.selectExpr("*", f"{near('lag')} AS lag_{k}", f"{near('lead')} AS lead_{k}")
        out = out.selectExpr(
            "*",
            f"CASE WHEN {stands} AND {active} THEN CASE WHEN {second} THEN lag_{k} WHEN {full} THEN lead_{k} END END AS sibling_{k}",
            f"CASE WHEN {stands} AND NOT {second} THEN CASE WHEN {active} THEN sha2(concat(node_{k}, CASE WHEN {full} THEN lead_{k} ELSE '' END), 256) ELSE node_{k} END END AS node_{k + 1}",
        )
    return out


def _spread(climbed: DataFrame, levels: int, kept: list[str]) -> DataFrame:
    """(kept, g, block, steps): for each row the siblings of its ancestors inside the block, as (slot, sibling), null sibling for a run of one.

    An ancestor's sibling stands on the last row before that begins its level's subtree.
    """
    running = "OVER (PARTITION BY g, block ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    held = [f"last(CASE WHEN idx % {1 << k} = 0 THEN struct(sibling_{k} AS s) END, true) {running} AS step_{k}" for k in range(levels)]
    steps = [f"CASE WHEN n > {1 << k} THEN struct(CAST(shiftright(idx, {k}) % 2 AS INT) AS slot, step_{k}.s AS sibling) END" for k in range(levels)]
    own = [*kept, "g", "block"]
    spread = climbed.selectExpr(*own, *[c for c in ("idx", "n") if c not in kept], *held)
    return spread.selectExpr(*own, f"CAST(filter(array({', '.join(steps)}), x -> x IS NOT NULL) AS {PATH}) AS steps")


def proven(nodes: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame], levels: int) -> DataFrame:
    """nodes (g, idx, n, node, more) with path, the steps from the node up, and the columns that ``finish`` gives its group.

    ``finish`` gets the one node that remains of each group (g, node) and
    returns g, path and more columns. ``most`` is the largest n. A tier climbs
    at most ``levels`` levels in one exchange; its block roots are the next tier's nodes.
    """
    if most <= 1:
        return nodes.join(finish(nodes.select("g", "node")), "g")
    deep, levels = levels, min(levels, (most - 1).bit_length())
    climbed = _climb(nodes, levels)
    top = climbed.filter(F.col("idx") % (1 << levels) == 0)
    size = F.shiftright(F.col("n") + ((1 << levels) - 1), levels)
    above = written(top.select("g", F.col("block").alias("idx"), size.alias("n"), F.col(f"node_{levels}").alias("node")), "nodes")
    upper = proven(above, -(-most >> levels), finish, deep).drop("n", "node").withColumnsRenamed({"idx": "block", "path": "__up"})
    kept = [c for c in nodes.columns if c != "g"]
    joined = _spread(climbed, levels, kept).join(upper, ["g", "block"])
    return joined.withColumn("path", F.concat("steps", "__up")).drop("block", "steps", "__up")


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""

    def up(acc: Column, step: Column) -> Column:
        alone, other = step["sibling"].isNull(), step["sibling"]
        return F.when(alone, digest(acc)).when(step["slot"] == 0, digest(acc, other)).otherwise(digest(other, acc))

    return F.aggregate(path, start, up)


def proof(path: Column) -> Column:
    """sha256 of the path's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(leaves: DataFrame, group: str, order: str, leaf: str, levels: int = LEVELS) -> DataFrame:
    """leaves with subroot, root and path (slot and sibling of each level, null sibling for a run of one).

    Leaves of a group ascend by ``order``, null first and ties by leaf; groups
    ascend by their UTF-8 bytes, null first. Each level's runs of two are
    hashed until one node is left, for each group and then over the groups'
    subroots. A group of any size is cut into blocks of 2 ** levels nodes;
    nothing but block roots, one in 2 ** levels nodes, moves between tiers.
    Columns named like a result are replaced. An empty table gives an empty result.
    """
    # Groups as strings that are never null and in the same order.
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    rows = leaves.select(name.alias("g"), F.col(order).alias("__gs_order"), F.col(leaf).alias("node"), F.struct(*kept).alias("__gs_own"))

    def subroots(tops: DataFrame) -> DataFrame:
        trees = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("tree"), "node"), "g", ["tree"])
        root = lambda last: last.select("g", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
        found = proven(trees, _most(trees), root, levels)
        return found.select(F.col("tree").alias("g"), F.col("node").alias("subroot"), "root", "path")

    ranked = numbered(rows, "g", ["__gs_order", "node"])
    found = proven(ranked, _most(ranked), subroots, levels)
    return found.select(*[F.col("__gs_own")[c].alias(c) for c in kept], "subroot", "root", "path")


def tampered(doc_id: Column) -> Column:
    """Whether the tampering touches a row: 7 divides crc32 of its decimal id; a null id is never touched."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document.

    folded_root starts from the leaf of the tampered row (n_chars one higher;
    null stays) and uses the original siblings. Any field may be null; repeated
    rows are leaves of their own.
    """
    leaf = digest(*[encoded(F.col(c)) for c in FIELDS])
    changed = digest(*[encoded(F.col(c).cast("bigint") + 1 if c == "n_chars" else F.col(c)) for c in FIELDS])
    touched = tampered(F.col("doc_id")) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(touched, changed).alias("changed"))
    found = manifest(leaves, "lang", "doc_id", "leaf", levels)
    folded = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Merkle manifest of a dataset: a digest per row, a tree per group, a root over the groups, and a proof for each row.

Rows are ranked within their group. The rank is cut into a block number and digits in base ``arity``; inside a block the
digit columns are grouped away one after the other, the last digit first, and every node becomes a struct of its digest
and its children's structs. All these groupings share one partitioning by group and block, so a block is put together
without another shuffle. A block holds ``arity ** levels`` nodes at most, however many rows a group has; the digests of
its blocks are the nodes of the next layer, until one is left, and the groups' digests are one more tree.

Proofs come back down the same way: a layer's block meets what leads from it to the root, both brought together by a
grouping of their union (no join), one transform over the nested structs hands the way down to the leaves, and explode
emits a row for each. Blocks are written once a layer; nothing passes through the driver but the number of layers.

A tree of one node is its own root: where a tree has come to one node, further levels and layers pass it on as it is.

Defined results: a null is encoded as ``-``, anything else as its length in UTF-8 bytes, a colon and its text; a null group is
a group of its own and comes first; rows are ordered by ``order_by``, nulls first, then by digest, so equal rows are
leaves side by side; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranking import row_numbers
from marquee.operators.settle import settle


@dataclass(frozen=True)
class Shape:
    """``arity`` nodes become one; a block is ``levels`` levels high."""

    arity: int = 2
    levels: int = 6

    @property
    def block(self) -> int:
        return self.arity**self.levels


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*[encoded(value) for value in values]), 256)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _left(of: Column, arity: int, level: int) -> Column:
    """How many nodes of a tree of ``of`` leaves are left after so many levels."""
    return F.ceil(of / F.lit(float(arity**level)))


def _digests(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")


def _rolled(nodes: DataFrame, key: Sequence[str], shape: Shape) -> DataFrame:
    """``nodes`` (key, at, of, digest, item) -> a row per key and block: ``of`` and the nested ``node``."""
    digits = [(_div(F.col("at"), shape.arity**level) % shape.arity).alias(f"digit{level}") for level in range(shape.levels)]
    node = F.struct("digest", "item").alias("node")
    rows = nodes.select(*key, _div(F.col("at"), shape.block).alias("block"), "of", *digits, node).repartition(*key, "block")
    for level in range(shape.levels):
        higher = [f"digit{above}" for above in range(level + 1, shape.levels)]
        children = F.sort_array(F.collect_list(F.struct(F.col(f"digit{level}").alias("digit"), "node.*")))
        rows = rows.groupBy(*key, "block", "of", *higher).agg(children.alias("children"))
        alone = _left(F.col("of"), shape.arity, level) == 1
        digest = F.when(alone, F.col("children")[0]["digest"]).otherwise(F.sha2(_digests(F.col("children")), 256))
        rows = rows.select(*key, "block", "of", *higher, F.struct(digest.alias("digest"), "children").alias("node"))
    return rows


def _layers(nodes: DataFrame, key: Sequence[str], shape: Shape) -> list[DataFrame]:
    """Written blocks of every layer, the leaves' first; in the last a tree has one block."""
    layers = []
    while True:
        blocks = settle(_rolled(nodes, key, shape), "merkle-blocks")
        layers.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return layers
        left = _left(F.col("of"), shape.arity, shape.levels).alias("of")
        nodes = blocks.select(
            *key, F.col("block").alias("at"), left, F.col("node.digest").alias("digest"), F.struct("block").alias("item")
        )


def _step(children: Column, at: Column) -> Column:
    """What a child is hashed with: the digests before and after it."""
    n = F.size(children)
    return F.struct(
        _digests(F.slice(children, F.lit(1), at)).alias("before"),
        _digests(F.slice(children, at + 2, F.greatest(n - at - 1, F.lit(0)))).alias("after"),
    )


def _leaves(node: Column, of: Column, way: Column, level: int, shape: Shape) -> Column:
    """The leaves below ``node``, which is ``level`` levels above them, each with its way up."""
    if level == 0:
        return F.array(F.struct(node["item"].alias("item"), node["digest"].alias("digest"), way.alias("way")))
    alone = _left(of, shape.arity, level - 1) == 1

    def below(child: Column, at: Column) -> Column:
        step = F.filter(F.array(_step(node["children"], at)), lambda _: ~alone)
        return _leaves(child, of, F.concat(step, way), level - 1, shape)

    return F.flatten(F.transform(node["children"], below))


def _descended(layers: list[DataFrame], key: Sequence[str], above: DataFrame, shape: Shape) -> DataFrame:
    """A row per leaf: key, item, digest and ``above``, to whose ``way`` the tree's own steps are added in front.

    ``above`` gives every key its struct: ``way`` and whatever else the leaves are to know.
    """
    above = above.select(*key, F.lit(0).cast("long").alias("block"), "above")
    for blocks in reversed(layers):
        nothing = [F.lit(None).cast(blocks.schema[name].dataType).alias(name) for name in ("of", "node")]
        unknown = F.lit(None).cast(above.schema["above"].dataType).alias("above")
        both = blocks.select(*key, "block", "of", "node", unknown).unionAll(above.select(*key, "block", *nothing, "above"))
        met = both.groupBy(*key, "block").agg(*[F.first(name, ignorenulls=True).alias(name) for name in ("of", "node", "above")])
        found = F.explode(_leaves(F.col("node"), F.col("of"), F.col("above.way"), shape.levels, shape)).alias("leaf")
        rows = met.select(*key, "above", found)
        below = rows.select(
            *key, F.col("leaf.item").alias("item"), F.col("leaf.digest").alias("digest"),
            F.col("above").withField("way", F.col("leaf.way")).alias("above"),
        )
        above = below.select(*key, "item.*", "above") if blocks is not layers[0] else below
    return above


def prove(rows: DataFrame, group: str, order_by: Sequence[str], carried: Sequence[str] = (), shape: Shape = Shape()) -> DataFrame:
    """``rows`` (group, order_by, carried, leaf) with the ``way`` from each leaf to the ``root``, and its ``subroot``.

    ``way`` is an array of what a node is hashed with on each level, (before, after). ``carried`` columns ride along.
    """
    kept = list(dict.fromkeys([*order_by, *carried]))
    rows = settle(rows.select(F.col(group).alias("group"), F.struct(*kept).alias("item"), F.col("leaf").alias("digest")), "merkle-leaves")
    order = [F.col("item").getField(name).asc_nulls_first() for name in order_by]
    numbered = row_numbers(rows, [*order, F.asc("digest"), F.asc("item")], within=["group"], name="place", total="of")
    trees = _layers(numbered.withColumn("at", F.col("place") - 1), ["group"], shape)

    roots = trees[-1].select(F.col("node.digest").alias("digest"), F.struct("group").alias("item"))
    roots = row_numbers(roots, [F.col("item.group").asc_nulls_first()], name="place", total="of")
    top = _layers(roots.withColumn("at", F.col("place") - 1), [], shape)

    none = F.array().cast("array<struct<before:string,after:string>>")
    root = top[-1].select(F.struct(none.alias("way"), F.col("node.digest").alias("root")).alias("above"))
    groups = _descended(top, [], root, shape)
    above = groups.select("item.group", F.col("above").withField("subroot", F.col("digest")).alias("above"))
    leaves = _descended(trees, ["group"], above, shape)
    return leaves.select(F.col("group").alias(group), *[F.col("item").getField(name).alias(name) for name in kept],
                         F.col("digest").alias("leaf"), "above.way", "above.subroot", "above.root")


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf leads to."""
    return F.aggregate(way, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(way: Column) -> Column:
    """A digest of all digests on the way."""
    return F.sha2(F.array_join(F.transform(way, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def tampered(doc_id: Column, modulus: int = 7) -> Column:
    """Which rows a check of the proofs alters."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 0, F.lit(False))


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Proofs for ``docs`` (doc_id, source, lang, n_chars, text), grouped by lang; each tried with its row or an altered one."""
    def digest(n_chars: Column) -> Column:
        return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    more = F.col("n_chars").cast("decimal(38,0)") + 1
    altered = F.when(tampered(F.col("doc_id")), digest(more))
    rows = docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), altered.alias("altered"))
    proved = prove(rows, "lang", ["doc_id"], ["altered"], shape)
    fold = folded(F.coalesce("altered", "leaf"), F.col("way"))
    proved = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("way")).alias("proof_sha256"), fold.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))

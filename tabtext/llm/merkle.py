"""Merkle manifest of a dataset: leaves, roots, membership proofs (operator 11), DataFrame operations only.

Every row is a leaf, the SHA-256 of its columns in a prefix-free spelling.  The leaves of a group (source), in the order
of their key, are hashed in runs of ``FAN`` until one node is left, and the groups' roots likewise.  Hashes are hex text.

Leaves get their rank without a window over a group: a range partitioning by (group, key) is written with each
row's place in its partition, and the counts of the partitions give the offsets.  An aligned block of FAN ** LEVELS
neighbouring nodes is one row that holds every level of its subtree as one concatenated hex string: parents are the hashes
of the string's fixed-width substrings, and a node's siblings are the substrings on its two sides.  The block roots
are the nodes of the next round, so a round has 1/243 of the rows of the one before.  On the way down a block
hands its path (the left and right siblings of each level) to its nodes.  No group, however large, meets in one task.

Defined cases: a null column is ``-`` in the spelling; a null group is a group of its own and comes first; rows with
a null key come first in their group and are never tampered with; rows with equal keys are ordered by their leaf, and equal
rows are leaves of their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 3
#: A block holds FAN ** LEVELS = 243 nodes: 16 KB of hex text at its lowest level.
LEVELS = 5
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def spelled(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[spelled(c) for c in columns]), 256)


# -- ranks ----------------------------------------------------------------------------------------

def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order`` within ``group``) and ``total`` (rows of the group)."""
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                     .withColumn("part", F.shiftright(at, 33)).withColumn("nth", at.bitwiseAND((1 << 33) - 1)), name)
    counts = written(placed.groupBy(group, "part").agg(F.min("nth").alias("low"), F.count(F.lit(1)).alias("n")), f"{name}-counts")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("base"),
                            F.sum("n").over(Window.partitionBy(group)).alias("total"))
    return placed.join(offsets, [group, "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "low", "base")


# -- levels ---------------------------------------------------------------------------------------

def parents(level: Column) -> Column:
    """The next level: a hash of every FAN hashes, the last of as many as are left."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * width + 1, F.lit(width)), 256)), "")


def blocks(nodes: DataFrame, group: str, levels: int, name: str) -> DataFrame:
    """Aligned blocks of ``nodes`` (group, rank, total, node, item), as a written table: ``block, total, items``
    (rank, node and item of every one) and ``l0 .. l5``, the levels; unused levels are null and ``root`` is the last."""
    size = FAN ** levels
    b = (nodes.withColumn("block", F.floor(F.col("rank") / size)).groupBy(group, "block")
         .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "node", "item"))).alias("items")))
    b = b.withColumn("l0", F.array_join(F.col("items.node"), ""))
    for k in range(1, levels + 1):
        below = F.col(f"l{k - 1}")
        # a group of one block is done when one node is left; others go up all levels, as other blocks do
        b = b.withColumn(f"l{k}", F.when((F.length(below) > HEX) | (F.col("total") > size), parents(below)))
    root = F.coalesce(*[F.col(f"l{k}") for k in range(levels, -1, -1)])
    return written(b.withColumn("root", root), name)


def path(place: Column, levels: int) -> Column:
    """The (left, right) siblings on every level of the node at ``place`` of its block."""
    steps = []
    for k in range(levels):
        i = F.floor(place / FAN ** k)
        child = i % FAN
        left = F.substr(F.col(f"l{k}"), ((i - child) * HEX + 1).cast("int"), (child * HEX).cast("int"))
        right = F.substr(F.col(f"l{k}"), ((i + 1) * HEX + 1).cast("int"), ((FAN - 1 - child) * HEX).cast("int"))
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def climb(nodes: DataFrame, group: str, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The blocks of every round, until each group is one block, whose ``root`` is the group's.

    ``nodes`` has ``group, rank, total, node, item``."""
    size = FAN ** levels
    rounds = [blocks(nodes, group, levels, f"{name}-0")]
    largest = rounds[0].agg(F.max("total")).first()[0] or 0
    while largest > size:
        largest = -(-largest // size)
        up = rounds[-1].select(group, F.col("block").alias("rank"), F.ceil(F.col("total") / size).alias("total"),
                               F.col("root").alias("node"), F.lit(None).cast("long").alias("item"))
        rounds.append(blocks(up, group, levels, f"{name}-{len(rounds)}"))
    return rounds


def descend(rounds: list[DataFrame], group: str, above: DataFrame, carried: list[str], levels: int = LEVELS) -> DataFrame:
    """``group, rank, node, item, path`` of the first round's nodes and the ``carried`` columns of their group.

    ``above`` has one row per group: ``group, path`` from the group's root on, and the carried columns."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for b in reversed(rounds):
        at = F.transform("items", lambda x: F.struct(x["rank"].alias("rank"), x["node"].alias("node"), x["item"].alias("item"),
                                                     path(x["rank"] % FAN ** levels, levels).alias("own")))
        spread = (b.select(group, "block", at.alias("items")).join(above, [group, "block"])
                  .select(group, "path", *carried, F.explode("items").alias("at")))
        below = spread.select(group, F.col("at.rank").alias("rank"), F.col("at.node").alias("node"), F.col("at.item").alias("item"),
                              F.concat("at.own", "path").alias("path"), *carried)
        above = below.select(group, F.col("rank").alias("block"), "path", *carried)
    return below


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(steps: Column) -> Column:
    """The siblings of all levels, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


# -- the manifest ---------------------------------------------------------------------------------

def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source",
             changed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: ``key, leaf, checked_leaf, path, subroot, root``.

    ``path`` lists the (left, right) siblings from the leaf to the root.  ``checked_leaf`` is the leaf of the row with the
    columns of ``changed`` in place of its own: a proof of a row as someone else holds it."""
    own = {c: F.col(f"`{c}`") for c in columns}
    order = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # null before all others
    leaf = docs.select(F.col(f"`{key}`").alias("key"), order.alias("grp"), leaf_hash([*own.values()]).alias("node"),
                       leaf_hash([*(own | (changed or {})).values()]).alias("checked"))
    leaf = leaf.withColumn("item", F.struct("key", F.when(F.col("checked") != F.col("node"), F.col("checked")).alias("checked")))
    nodes = ranked(leaf.select("grp", "key", "node", "item"), "grp", ["key", "node"], "merkle-leaves")
    rounds = climb(nodes, "grp", "merkle", levels)
    subroots = rounds[-1].select(F.lit(0).alias("all"), "grp", F.col("root").alias("node"), F.col("grp").alias("item"))
    tops = climb(ranked(subroots, "all", ["grp"], "merkle-subroots"), "all", "merkle-top", levels)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = tops[-1].select("all", F.col("root").alias("top"), none.alias("path"))
    upper = descend(tops, "all", root, ["top"], levels)
    upper = upper.select(F.col("item").alias("grp"), "path", F.col("node").alias("subroot"), "top")
    leaves = descend(rounds, "grp", written(upper, "merkle-upper"), ["subroot", "top"], levels)
    return leaves.select(F.col("item.key").alias("key"), F.col("node").alias("leaf"),
                         F.coalesce("item.checked", "node").alias("checked_leaf"), "path", "subroot", F.col("top").alias("root"))


def without_line_ends(doc_id: str = "doc_id", text: str = "text", every: int = 2) -> dict[str, Column]:
    """Tampering: the text loses its \\n characters where ``every`` divides the crc32 of the decimal id."""
    hit = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % every == 0
    return {text: F.when(F.coalesce(hit, F.lit(False)), F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit(""))).otherwise(F.col(f"`{text}`"))}


def verify(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves, roots and proofs of ``docs``, and whether each row as tampered with still folds to the root."""
    m = manifest(docs, changed=without_line_ends(), levels=levels)
    folded_root = folded(F.col("checked_leaf"), F.col("path"))
    return (m.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                     folded_root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

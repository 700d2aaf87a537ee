"""Merkle manifest of a dataset, with every row's proof found by pointer jumping.

A row's leaf hashes its fields. The rows of each group (language) form a tree, in which every
eight consecutive nodes become their hash; the subroots of all groups, in order, form a tree
of the same kind, whose top is the root. A proof is the list of what stands before and after
the own node among its siblings, from the leaf's run to the root's.

Places are found without a window over a group: rows are sorted over ranges of all rows, and a
table of one row for each partition and group tells where each part begins. Every level of a
tree is one aggregate, an eighth of the one below. Each node then points at its parent and
holds the siblings' hashes on that step; joining the nodes with themselves replaces a pointer
by the one that its target has and appends the target's hashes, so the distance doubles, until
all point at the root. A node that is the target of many others is one of few: below a
counted bound targets are broadcast, beyond it no target has more than a small share of the
nodes. Leaves, which are eight times as many, take their parent's whole proof in one last join.

Nulls: a null field is hashed as `-`; null groups and null ids come first. Ties: rows with one
id follow by their leaf, so repeated rows have equal leaves and different proofs. An empty
table has no root and gives no rows. Other columns of the input, whatever their names, are not
read. A group of a single row has that row's leaf as its subroot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.llm.frames import bounded_broadcast, id_remainder
from plumeria.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Targets of pointers are broadcast up to this many; each holds a few hundred bytes for each step it spans.
BROADCAST_TARGETS = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree of all subroots has this number, the trees of groups count from 0.
_TOP = -1


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def row_digest(values: Sequence[Column]) -> Column:
    """The hash of some fields, each told with its length in bytes."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, values)), 256))


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds `place`, from 0 in the order of each group, and `width`, the rows of the group; nulls come first.

    No group is one task's work: all rows are cut into ranges of (groups, order).
    """
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    # Equal rows are told apart, so that their number doesn't make a range too long.
    ranged = rows.withColumn("_any", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, "_any").sortWithinPartitions(*keys, "_any").drop("_any")
    ranged = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = ranged.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row for each partition and group.
    within = F.lit(0) if not groups else F.struct(*groups)
    parts = parts.withColumn("_within", within).selectExpr(
        "*",
        "coalesce(sum(_n) OVER (PARTITION BY _within ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        "sum(_n) OVER (PARTITION BY _within) AS width",
    )
    parts = cut_lineage(parts.drop("_within", "_n"))
    known = parts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), "_first", "_before", "width")
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    placed = ranged.join(bounded_broadcast(known, known.count()), same)
    return placed.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "width")


def _joined(nodes: Column) -> Column:
    """The hash of several nodes in order."""
    return F.unhex(F.sha2(F.array_join(F.transform(nodes, lambda x: hexed(x["hash"])), ""), 256))


def _several(nodes: Column) -> Column:
    return F.unhex(F.array_join(F.transform(nodes, lambda x: F.hex(x["hash"])), ""))


def _step(siblings: Column, place: Column, fan: int) -> Column:
    """What stands before and after the node at `place`, counted from 0."""
    before, after = F.slice(siblings, F.lit(1), place), F.slice(siblings, place + 2, F.lit(fan))
    return F.struct(_several(before).alias("before"), _several(after).alias("after"))


def _key(tree: Column, level: int, at: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), F.lit(level).alias("level"), at.cast("long").alias("at"))


def _climb(nodes: DataFrame, level: int, widest: int, fan: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Builds trees upward from nodes (tree, at, width, node, hash) until each tree has one.

    Returns the pointers of each level, the tops (node, hash, tree), and the number of levels.
    """
    pointers, tops, rounds = [], [], 0
    while True:
        tops.append(nodes.where("width = 1").select("tree", "node", "hash"))
        if widest <= 1:
            break
        up = F.floor(F.col("at") / fan).cast("long")
        run = F.sort_array(F.collect_list(F.struct("at", "node", "hash")))
        parents = nodes.where("width > 1").groupBy("tree", up.alias("up"), "width").agg(run.alias("run"))
        parents = cut_lineage(parents.withColumn("parent", _key(F.col("tree"), level + rounds + 1, F.col("up"))))
        steps = parents.select("parent", "run", F.posexplode("run").alias("k", "child"))
        pointers.append(
            steps.select(F.col("child.node").alias("node"), F.col("parent").alias("target"), F.array(_step(F.col("run"), F.col("k"), fan)).alias("steps"), "child.hash")
        )
        nodes = parents.select(
            "tree", F.col("up").alias("at"), F.ceil(F.col("width") / fan).cast("long").alias("width"), F.col("parent").alias("node"), _joined(F.col("run")).alias("hash")
        )
        widest, rounds = -(-widest // fan), rounds + 1
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return pointers, top, rounds


def _jump(pointers: DataFrame, root: Column, longest: int) -> DataFrame:
    """node, target, steps, subroot with every target at the root: each round doubles the distance."""
    for _ in range(max(longest - 1, 0).bit_length()):
        sought = pointers.where(F.col("target") != root).select("target").distinct()
        sought = cut_lineage(sought)
        n = sought.count()
        if not n:
            break
        few = bounded_broadcast(sought.withColumnRenamed("target", "node"), n, BROADCAST_TARGETS)
        hops = pointers.join(few, "node", "left_semi")
        hops = hops.select(F.col("node").alias("target"), F.col("target").alias("_target"), F.col("steps").alias("_steps"), F.col("subroot").alias("_subroot"))
        joined = pointers.join(bounded_broadcast(hops, n, BROADCAST_TARGETS), "target", "left")
        steps = F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps"))
        pointers = cut_lineage(
            joined.select("node", F.coalesce("_target", "target").alias("target"), steps.alias("steps"), F.coalesce("subroot", "_subroot").alias("subroot"))
        )
    return pointers


def manifest(
    docs: DataFrame,
    found: Mapping[str, Column] | None = None,
    *,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    fan: int = FAN,
) -> DataFrame:
    """Of every row: its id, leaf, subroot, root and proof (steps of before, after), as binary hashes.

    `found` names fields that are read anew as other expressions; `found_leaf` is the leaf made of them.
    """
    found = found or {}
    rows = docs.select(
        F.col(order).alias("_id"),
        F.col(group).alias("_group"),
        row_digest([F.col(c) for c in fields]).alias("hash"),
        row_digest([found.get(c, F.col(c)) for c in fields]).alias("found"),
    )
    # Hashed once: the ranges of the sort are sampled from the hashes.
    placed = numbered(cut_lineage(rows), ["_group"], ["_id", "hash"])
    placed = cut_lineage(placed)
    trees = numbered(placed.groupBy("_group").agg(F.max("width").alias("leaves")), [], ["_group"])
    trees = cut_lineage(trees.select(F.col("_group").alias("_g"), F.col("place").alias("tree"), "leaves", F.col("width").alias("trees")))
    widest, n_trees = trees.agg(F.max("leaves"), F.count("*")).first()
    leaves = placed.join(bounded_broadcast(trees, n_trees), F.col("_group").eqNullSafe(F.col("_g")))
    run = F.sort_array(F.collect_list(F.struct("place", "hash", "found", "_id")))
    runs = leaves.groupBy("tree", F.floor(F.col("place") / fan).cast("long").alias("at"), "width").agg(run.alias("run"))
    alone = F.col("width") == 1
    runs = cut_lineage(runs.withColumn("node", _key(F.col("tree"), 1, F.col("at"))))
    nodes = runs.select(
        "tree", "at", F.ceil(F.col("width") / fan).cast("long").alias("width"), "node", F.when(alone, F.col("run")[0]["hash"]).otherwise(_joined(F.col("run"))).alias("hash")
    )
    pointers, subroots, rounds = _climb(nodes, 1, -(-(widest or 0) // fan), fan)
    subroots = cut_lineage(subroots)
    below = subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("width"), "node", "hash")
    above, root, more = _climb(below, 0, n_trees, fan)
    top = root.first()
    none = F.lit(None).cast("binary")
    root_hash = none if top is None else F.lit(bytes(top["hash"]))
    root_key = F.struct(*(F.lit(v).cast(t).alias(c) for c, t, v in zip(("tree", "level", "at"), ("long", "int", "long"), top["node"] if top else (None,) * 3)))
    all_steps = [p.select("node", "target", "steps", none.alias("subroot")) for p in pointers]
    # The pointers that leave the trees of groups know the subroot.
    all_steps += [p.select("node", "target", "steps", F.when(F.col("node.tree") != _TOP, F.col("hash")).alias("subroot")) for p in above]
    if all_steps:
        joined = all_steps[0]
        for p in all_steps[1:]:
            joined = joined.unionByName(p)
        paths = _jump(cut_lineage(joined), root_key, rounds + more)
        runs = runs.join(paths.where("node.tree >= 0 AND node.level = 1").select("node", "steps", "subroot"), "node", "left")
    else:
        runs = runs.withColumns({"steps": F.lit(None).cast("array<struct<before:binary,after:binary>>"), "subroot": none})
    each = runs.select("run", "steps", "subroot", alone.alias("alone"), F.posexplode("run").alias("k", "row"))
    above_run = F.coalesce("steps", F.array().cast("array<struct<before:binary,after:binary>>"))
    own = F.array(_step(F.col("run"), F.col("k"), fan))
    return each.select(
        F.col("row._id").alias(order),
        F.col("row.hash").alias("leaf"),
        F.coalesce("subroot", root_hash).alias("subroot"),
        root_hash.alias("root"),
        F.when(F.col("alone"), above_run).otherwise(F.concat(own, above_run)).alias("proof"),
        F.col("row.found").alias("found_leaf"),
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root, in hex, that a leaf and its proof lead to."""
    return F.aggregate(proof, hexed(leaf), lambda h, step: F.sha2(F.concat(hexed(step["before"]), h, hexed(step["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(hexed(step["before"]), hexed(step["after"]))), ""), 256)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of the documents, checked against texts of which a third (by id) have lost their capitals.

    A null id counts as the empty text in choosing that third.
    """
    tampered = F.when(id_remainder("doc_id", 3) == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    made = manifest(docs, {"text": tampered})
    made = made.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.col("found_leaf"), F.col("proof")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))

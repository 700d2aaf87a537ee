"""Mixing sources to target weights with a splitting tree of block quotas.

Every source is cut into blocks by a hash of its documents, so a source with a third
of all rows is spread like any other. A source's target says how many blocks it gives:
all of them once for every whole pass, and of one more pass the blocks that come first
in a seeded permutation. A binary tree then deals these block quotas out to shards: a
node gives its left half a multivariate-hypergeometric draw of its quotas, so every
shard has equally many blocks and every assignment of blocks is equally likely. A shard
takes the next blocks of a source in permuted order, which makes the draws disjoint, and
its rows are shuffled inside the shard.

All work on documents is column expressions; what is drawn are blocks, a bounded number
for each source. Nulls: a null text has size 0, a null source is a source of its own,
last in order; a null id is an id. Repeated rows are rows of their own. A source without
words has target 0, and an empty table gives an empty result. Ties in a permutation are
settled by block number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.frames import bounded_broadcast, word_count
from plumeria.session import cut_lineage

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3

SHARD_WORDS = 1_000_000_000
LEAST_SHARDS = 16
BLOCKS = 1024
BLOCKS_PER_SHARD = 8


@dataclass(frozen=True)
class Mix:
    """plan: source, _block, source_size, target, draws (shard, pass); and how many blocks and shards there are."""

    plan: DataFrame
    blocks: int
    shards: int


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> and weight, target: words by weight, at most three times a source's size.

    Takes one row per source. A source is full if its ceiling is below its share at the common
    level (words for each unit of weight); each pass fixes the full ones and raises the level.
    """
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    sources = cut_lineage(
        ranked.select("source", "_rank", "source_size", weight.alias("weight"), (F.col("source_size") * MOST_REPEATS).cast("double").alias("_most"))
    )
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / (weights or 1), -1
    while True:
        is_full = F.col("_most") < F.col("weight") * F.lit(level)
        n, words, weight_full = sources.where(is_full).agg(F.count("*"), F.sum("_most"), F.sum("weight")).first()
        if n == full or n == 0 or weight_full == weights:
            break
        full, level = n, (total - words) / (weights - weight_full)
    return sources.select("source", "_rank", "source_size", "weight", F.least("_most", F.col("weight") * F.lit(float(level))).alias("target"))


def hypergeometric(marked: Column, total: Column, drawn: Column, at: Column) -> Column:
    """The number of marked units among `drawn` of `total`, by inversion at a uniform number.

    Probabilities follow from their ratios, in logarithms; the support is cut 12 standard
    deviations from the mean, where a double holds no more of it.
    """
    marked, total, drawn = (x.cast("double") for x in (marked, total, drawn))
    mean = drawn * marked / F.greatest(total, F.lit(1.0))
    reach = 12 * F.sqrt(mean * (1 - marked / F.greatest(total, F.lit(1.0))) + 1) + 12
    least = F.greatest(F.lit(0.0), drawn - (total - marked), F.floor(mean - reach).cast("double"))
    most = F.least(drawn, marked, F.ceil(mean + reach).cast("double"))
    steps = F.when(most > least, F.sequence(least.cast("long"), (most - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(logs: Column, k: Column) -> Column:
        ratio = (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))
        return F.concat(logs, F.array(F.element_at(logs, -1) + F.log(ratio)))

    logs = F.aggregate(steps, F.array(F.lit(0.0)), step)
    # The largest is taken out before exp, else small tails lose everything.
    chances = let(logs, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top))))
    return let(chances, lambda x: _below(x, at)) + least.cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _below(chances: Column, at: Column) -> Column:
    """How many leading chances sum to less than the share `at` of all."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))

    def count(level: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            after = state["sum"] + x
            return F.struct(after.alias("sum"), (state["below"] + F.when(after < level, 1).otherwise(0)).cast("long").alias("below"))

        return F.least(F.aggregate(chances, start, step)["below"], F.size(chances).cast("long") - 1)

    return let(F.aggregate(chances, F.lit(0.0), lambda a, x: a + x) * at, count)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """_rank, quota -> shard, _rank, quota: one row per source and shard that gets blocks of it.

    The state is one array of quotas per node, as long as there are sources.
    """
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "quota"))), lambda x: x["quota"]).alias("quotas"))
    ranks = quotas.agg(F.array_sort(F.collect_list("_rank")).alias("ranks"))
    nodes = nodes.withColumn("node", F.lit(1).cast("long"))
    for _ in range((shards - 1).bit_length()):
        units = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        # Halves of an odd number go to either side alike.
        left_units = F.floor(units / 2) + F.when((units % 2 == 1) & (uniform(seed, F.lit("odd"), F.col("node")) < 0.5), 1).otherwise(0)
        start = F.struct(units.alias("rest"), left_units.cast("long").alias("open"), F.array().cast("array<bigint>").alias("left"))

        def deal(state: Column, quota: Column) -> Column:
            at = uniform(seed, F.col("node"), F.size(state["left"]))
            got = hypergeometric(quota, state["rest"], state["open"], at).cast("long")
            return let(
                got,
                lambda g: F.struct((state["rest"] - quota).alias("rest"), (state["open"] - g).alias("open"), F.concat(state["left"], F.array(g)).alias("left")),
            )

        left = nodes.withColumn("left", F.aggregate("quotas", start, deal)["left"])
        child = F.explode(
            F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")),
            )
        )
        nodes = cut_lineage(left.select(child.alias("c")).select("c.node", "c.quotas"))
    parts = nodes.crossJoin(F.broadcast(ranks)).select((F.col("node") - shards).alias("shard"), F.explode(F.arrays_zip("ranks", "quotas")).alias("p"))
    return parts.select("shard", F.col("p.ranks").alias("_rank"), F.col("p.quotas").alias("quota")).where("quota > 0")


def plan_mix(docs: DataFrame, seed: int = 1, shard_words: int = SHARD_WORDS) -> Mix:
    """Decides which block of which source goes to which shards.

    Shards hold about `shard_words` words, 16 shards at least; a source has 1,024 blocks, or
    8 for each shard if that is more.
    """
    counted = docs.select("doc_id", "text", "source", word_count(F.col("text")).alias("_size"))
    per_source = cut_lineage(counted.groupBy("source").agg(F.sum("_size").alias("source_size")))
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    shards = 1 << (max(LEAST_SHARDS, -(-total // shard_words)) - 1).bit_length()
    blocks = max(BLOCKS, BLOCKS_PER_SHARD * shards)
    targets = source_targets(per_source)

    sized = with_blocks(docs.select("doc_id", "text", "source"), blocks, seed)
    per_block = cut_lineage(sized.groupBy("source", "_block").agg(F.sum("_size").alias("words")))
    placed = per_block.join(targets, per_block["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    order = Window.partitionBy("_rank").orderBy("_order", "_block")
    placed = (
        placed.withColumn("passes", passes)
        .withColumn("_order", F.xxhash64(F.lit(seed), F.lit("order"), "_rank", "_block"))
        .withColumn("place", F.row_number().over(order).cast("long"))
        .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("n", F.count("*").over(Window.partitionBy("_rank")))
        # The prefix of the last pass whose words come nearest to what is left of the target.
        .withColumn("last", (F.col("before") + F.col("words") / 2 < F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    )
    placed = cut_lineage(placed)
    quotas = placed.groupBy("_rank").agg((F.max("passes") * F.max("n") + F.sum("last")).alias("quota"))
    parts = split_quotas(quotas, shards, seed)
    ends = parts.withColumn("to", F.sum("quota").over(Window.partitionBy("_rank").orderBy("shard")))
    ends = ends.select("_rank", "shard", "to", (F.col("to") - F.col("quota")).alias("from"))
    # The k-th draw of a source is block `place` of pass k / n.
    draws = placed.where(F.col("passes") + F.col("last") > 0).select(
        "_rank", "_block", "n", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") + F.col("last") - 1)).alias("pass")
    )
    draws = draws.withColumn("draw", F.col("pass") * F.col("n") + F.col("place")).join(ends, "_rank")
    draws = draws.where((F.col("draw") > F.col("from")) & (F.col("draw") <= F.col("to")))
    drawn = draws.groupBy("_rank", "_block").agg(F.array_sort(F.collect_list(F.struct("shard", "pass"))).alias("draws"))
    plan = placed.join(drawn, ["_rank", "_block"], "left").select(
        "source", "_block", "source_size", "target", F.coalesce("draws", F.array().cast("array<struct<shard:bigint,pass:bigint>>")).alias("draws")
    )
    return Mix(cut_lineage(plan), blocks, shards)


def with_blocks(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Adds _size, the words of the text, and _block, by a hash of id and text."""
    return docs.withColumn("_size", word_count(F.col("text"))).withColumn(
        "_block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id", "text"), F.lit(blocks))
    )


def taken(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of every document."""
    mix = plan_mix(docs, seed)
    sized = with_blocks(docs.select("doc_id", "text", "source"), mix.blocks, seed).select("doc_id", "source", "_size", "_block")
    plan = mix.plan.select(F.col("source").alias("_source"), F.col("_block").alias("_plan_block"), "source_size", "target", F.size("draws").alias("_n"))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_plan_block")))
    return joined.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_n")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: each document as often as its block is drawn, with shard, pass and position.

    Rows of one shard are written together, in the order of `position`, a seeded shuffle.
    Columns that already have one of the three names are replaced.
    """
    mix = plan_mix(docs, seed)
    docs = docs.drop("shard", "pass", "position")
    # Rows travel as one column, so that their own columns may have any name.
    sized = with_blocks(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source"), mix.blocks, seed)
    plan = mix.plan.where(F.size("draws") > 0).select(F.col("source").alias("_source"), F.col("_block").alias("_plan_block"), "draws")
    plan = bounded_broadcast(plan, plan.count(), 1 << 18)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_plan_block")))
    rows = joined.select("_row", F.explode("draws").alias("_draw")).select("_row.*", "_draw.shard", "_draw.pass")
    position = F.xxhash64(F.lit(seed), F.lit("position"), "shard", "pass", "doc_id", "text")
    return rows.withColumn("position", position).repartition(mix.shards, "shard").sortWithinPartitions("shard", "position", "doc_id")

"""Mixing: targets against a plain loop, exact quotas, and the draw itself."""

import math
import random

from pyspark.sql import functions as F

from plumeria.llm import mixing

SCHEMA = "doc_id long, text string, source string, draws string, shard int"


def fixture(spark):
    random.seed(2)
    rows = []
    for source, n in (("a", 900), ("b", 30), ("c", 60), ("é", 200), (None, 120), ("z", 0)):
        rows += [(len(rows) + k, " ".join("w" * random.randrange(1, 6) for _ in range(random.randrange(1, 40))), source, "x", 1) for k in range(n)]
    rows += [(5000, None, "a", "x", 1), (5001, "", "b", "x", 1), (5002, " \n", "empty", "x", 1), (None, "one two", "a", "x", 1), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_targets(rows):
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target
        full |= over


def test_taken_words_follow_the_targets(spark):
    docs, rows = fixture(spark)
    sizes, target = brute_targets(rows)
    found = mixing.taken(docs).collect()
    assert len(found) == len(rows)
    again = mixing.taken(docs.repartition(5, "doc_id")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    by_id = {i: (len((t or "").split()), s) for i, t, s, *_ in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        size, source = by_id[r.doc_id]
        assert r["size"] == size and r.source_size == sizes[source]
        assert math.isclose(r.target, target[source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * size and (not size or r.taken % size == 0)
        taken[source] += r.taken
    # A block is a hash bucket of documents; the prefix of blocks nearest to the target is within half a block.
    largest = {s: max(size for size, x in by_id.values() if x == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= 3 * largest[s] for s in sizes)


def test_mixed_rows_equal_what_is_taken(spark):
    docs, rows = fixture(spark)
    mixed = mixing.mixed(docs)
    assert mixed.columns == ["doc_id", "text", "source", "draws", "shard", "pass", "position"]
    words = mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.taken(docs).collect() if r["size"]}
    copies = {0: 3}
    assert {r.doc_id: r.n for r in words if r.doc_id in taken} == {i: n * copies.get(i, 1) for i, n in taken.items() if n}
    # No pass gives a block, and so a document, twice.
    assert mixed.where("doc_id > 0").groupBy("doc_id", "pass").count().where("count > 1").count() == 0


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.taken(empty).collect() == [] and mixing.mixed(empty).collect() == []
    silent = spark.createDataFrame([(1, None, "a", "x", 1), (2, "", None, "x", 1)], SCHEMA)
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.taken(silent).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_quotas_are_split_exactly_and_evenly(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 37), (2, 0), (3, 1)], "_rank int, quota long")
    parts = mixing.split_quotas(quotas, 8, 3).collect()
    assert {k: sum(p.quota for p in parts if p._rank == k) for k in range(4)} == {0: 700, 1: 37, 2: 0, 3: 1}
    shards = [sum(p.quota for p in parts if p.shard == s) for s in range(8)]
    assert sum(shards) == 738 and max(shards) - min(shards) <= 1


def test_hypergeometric_draws_have_its_distribution(spark):
    n, (marked, total, drawn) = 4000, (30, 80, 25)
    at = (F.col("id") + 0.5) / n
    made = spark.range(n).select(mixing.hypergeometric(F.lit(marked), F.lit(total), F.lit(drawn), at).alias("k")).groupBy("k").count().collect()
    counts = {r.k: r["count"] for r in made}
    for k in range(26):
        chance = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert abs(counts.get(k, 0) / n - chance) <= 1.5 / n
    edges = spark.range(1).select(*[mixing.hypergeometric(*map(F.lit, x), F.lit(0.5)) for x in ((0, 10, 4), (10, 10, 4), (3, 10, 0), (3, 10, 10), (0, 0, 0))]).first()
    assert tuple(edges) == (0, 4, 0, 3, 0)

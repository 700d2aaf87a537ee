"""The manifest against a tree built level by level in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from plumeria.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, _id int, _group int, place int, node string"


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([hashed(*made[-1][k : k + 8]) for k in range(0, len(made[-1]), 8)])
    return made


def siblings(made, at):
    out = []
    for nodes in made[:-1]:
        run, k = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
        out.append((run[:k], run[k + 1 :]))
        at //= 8
    return out


def brute(rows):
    order = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf_of(r, r[1]) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(groups[g]):
            proof = siblings(trees[g], at) + siblings(top, k)
            changed = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 and r[1] is not None
            h = leaf_of(r, r[1].translate(LOWER) if changed else r[1])
            for before, after in proof:
                h = hashed(*before, h, *after)
            told = hashed(*(x for before, after in proof for x in before + after))
            out.append((r[0], leaf_of(r, r[1]), trees[g][-1][0], top[-1][0], told, h, h == top[-1][0]))
    return out


def rows(n, langs):
    made = [(k, f"Text {k} É\U0001f600", langs[k % len(langs)], f"s{k % 3}", k, "x", 1, 2, 3, 4, "y") for k in range(n)]
    return made


def compare(spark, made):
    got = merkle.verified(spark.createDataFrame(made, SCHEMA)).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(made), key=key)
    return got


@pytest.mark.parametrize("n,langs", [(1, ["a"]), (9, ["a"]), (20, ["a", "b"]), (600, ["a"] * 9 + ["b", None, "é"]), (75, [f"g{k}" for k in range(70)])])
def test_equals_a_tree_in_python(spark, n, langs):
    compare(spark, rows(n, langs))


def test_nulls_repeats_and_empty_texts(spark):
    extra = [
        (None, None, None, None, None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None, None),
        (3, "", "a", "", 0, "", 0, 0, 0, 0, ""),
        (3, "", "a", "", 0, "", 0, 0, 0, 0, ""),
        (3, "-", "", None, -5, "", 0, 0, 0, 0, ""),
        (-7, "A" * 200_000, "a", "s", 200_000, "", 0, 0, 0, 0, ""),
    ]
    compare(spark, rows(40, ["a", "b"]) + extra * 3)


def test_targets_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_TARGETS", 0)
    got = compare(spark, rows(700, ["a", "a", "a", "b"]))
    assert len({r.verified for r in got}) == 2


def test_an_empty_table_has_no_rows(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbers_follow_the_order_of_each_group(spark):
    made = [(k % 3 or None, k) for k in range(500)] + [(1, 7)] * 300
    got = merkle.numbered(spark.createDataFrame(made, "g long, v long").repartition(7), ["g"], ["v"]).collect()
    for g in (None, 1, 2):
        own = sorted((r.place, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for h, v in made if h == g)
        assert {r.width for r in got if r.g == g} == {len(own)}


def test_other_fields_groups_and_fans(spark):
    made = spark.createDataFrame([(f"k{j}", j % 2 == 0, "x" * j) for j in range(30)], "key string, side boolean, body string")
    found = merkle.manifest(made, {"body": F.col("body")}, fields=("key", "body"), group="side", order="key", fan=3)
    checked = found.select((merkle.folded(F.col("found_leaf"), F.col("proof")) == merkle.hexed(F.col("root"))).alias("same"), F.size("proof").alias("n")).collect()
    assert len(checked) == 30 and all(r.same for r in checked) and max(r.n for r in checked) == 4

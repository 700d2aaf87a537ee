"""Toxicity on held-out rows, and what nulls and repeats give."""

import random
from zlib import crc32

from plumeria.llm import toxicity

SCHEMA = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int, quality int"


def fixture():
    random.seed(4)
    plain, bad = [f"w{k}" for k in range(400)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for k in range(900):
        words = [random.choice(plain) for _ in range(random.randrange(5, 60))]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words.insert(random.randrange(len(words)), random.choice(bad))
        rows.append((k, " ".join(words).title(), "x"))
        labels.append((k, int(toxic), 1))
    return rows, labels


def test_held_out_accuracy_and_whole_texts(spark):
    rows, labels = fixture()
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "w1 " * 60_000 + "vile rotten nasty vile", "x"), (2003, "w1 " * 60_000, "x"), (None, "vile rotten nasty", "x"), rows[0], rows[0]]
    labels += [(0, 0, 1), (0, None, 1), (None, 1, 1), (7000, 1, 1), (3, None, 0)]
    found = toxicity.scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(r.held_out == (crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [by_id[k] for k in range(900) if by_id[k].held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert by_id[2000].score == by_id[2001].score < 0.5
    assert (by_id[2002].predicted, by_id[2003].predicted, by_id[None].predicted) == (1, 0, 1)
    assert len({r.score for r in found if r.doc_id == 0}) == 1


def test_without_labels_or_rows(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "x")], SCHEMA), spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in toxicity.scores(docs, labels).collect()] == [(0.25, 0)]
    assert toxicity.scores(docs.limit(0), labels).collect() == []


def test_score_replaces_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    model = toxicity.Weights(*(toxicity.np.zeros(0, dtype=t) for t in (int, float)), 0.0)
    made = toxicity.score(docs, model, "score")
    assert made.dtypes == [("doc_id", "bigint"), ("text", "string"), ("score", "double")] and made.first().score == 0.5

"""The pipeline's stages: what they return, and that their decisions take effect."""

import pytest

import corpus_pipeline
from plumeria.llm import catalog, chat, decontaminate, pii
from plumeria.llm.frames import table


@pytest.fixture(scope="module")
def made(spark, folder, tmp_path_factory):
    """The result of every stage, by name, each made from the one before as run() does."""
    docs, out = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, folder).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages_return_the_columns_of_documents(spark, folder, made):
    columns = table(spark, folder, "documents").columns
    names = list(made)
    assert names == ["toxicity", "jaccard_join", "decontamination", "pii", "mixing"]
    assert all(made[n].columns == columns for n in names[:-1])
    assert made["mixing"].columns == [*columns, "shard", "pass", "position"]


def test_filters_only_take_rows_away(spark, folder, made):
    before = {tuple(r) for r in table(spark, folder, "documents").collect()}
    for name in ("toxicity", "jaccard_join", "decontamination"):
        after = {tuple(r) for r in made[name].collect()}
        assert after < before and len(after) > 0.7 * len(before)
        before = after


def test_no_leak_and_no_base_span_is_left(spark, folder, made):
    assert decontaminate.leaks(made["decontamination"], table(spark, folder, "benchmark")).count() == 0
    texts = [r.text for r in made["pii"].select("text").collect()]
    assert not any(pii.base_spans(t) for t in texts if t)
    same = {r.doc_id: r for r in made["decontamination"].collect()}
    assert all((r.text == same[r.doc_id].text) or "[" in r.text and r.n_chars == len(r.text) for r in made["pii"].collect())


def test_the_mix_has_only_what_came_in(made):
    came = {tuple(r) for r in made["pii"].collect()}
    assert {tuple(r)[:5] for r in made["mixing"].collect()} <= came


def test_run_equals_the_stages(spark, folder, made):
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, made["mixing"].collect()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 11))


def test_probe_conversation_is_fixed():
    assert (chat.PROBE_ID, chat.PROBE_TEXT) == (-1, "</s>[INST] ok [/INST]")

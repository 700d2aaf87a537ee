"""Languages of held-out and of mixed texts."""

import random
from zlib import crc32

from plumeria.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": "ka lo mi tu ra".split(), "bb": "sch ung ei ver cht".split(), "cc": "ño ción ll qué ez".split()}


def text(lang, n, seed):
    random.seed(seed)
    return " ".join("".join(random.choice(SYLLABLES[lang]) for _ in range(random.randrange(1, 4))) for _ in range(n))


def test_held_out_and_mixed_texts(spark):
    rows = [(k, text(lang, random.Random(k).randrange(5, 200), k).title(), lang, "x") for k, lang in enumerate(["aa", "aa", "aa", "bb", "cc"] * 60)]
    extra = [
        (1000, text("aa", 100, 1) + " " + text("bb", 300, 2), None, "x"), (1001, text("cc", 40_000, 3), None, "x"), (1002, None, "aa", "x"), (1003, "", "bb", "x"),
        (1004, "123 !? 4", "cc", "x"), (1005, "漢字", None, "x"), (None, text("bb", 50, 4), "bb", "x"), rows[0], rows[0],
    ]
    found = langid.predictions(spark.createDataFrame(rows + extra, SCHEMA)).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in found}
    assert all(r.held_out == (crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in found)
    held = [by_id[k] for k in range(300) if by_id[k].held_out]
    assert held and all(r.lang_pred == ["aa", "aa", "aa", "bb", "cc"][r.doc_id % 5] and 0 <= r.score <= 1 for r in held)
    assert (by_id[1000].lang_pred, set(by_id[1000].langs)) == ("bb", {"aa", "bb"}) and 0.6 < by_id[1000].score < 0.9
    assert by_id[1001].langs == ["cc"] and by_id[1001].score == 1
    assert {by_id[k].lang_pred for k in (1002, 1003, 1004)} == {"und"} and by_id[1004].score == 0
    assert by_id[1005].lang_pred in SYLLABLES and by_id[None].lang_pred == "bb"


def test_without_training_rows(spark):
    assert langid.predictions(spark.createDataFrame([], SCHEMA)).collect() == []
    found = langid.predictions(spark.createDataFrame([(1, "abc def", None, "x")], SCHEMA)).first()
    assert (found.lang_pred, found.score, found.langs) == ("und", 0.0, [])


def test_trigrams_stay_inside_their_texts():
    both = langid.trigrams(langid.pa.array(["Ab", None, "c1d"]))
    apart = [langid.trigrams(langid.pa.array([t]))[1].tolist() for t in ("ab", "c d")]
    assert both[0].tolist() == [0, 0, 2, 2] and both[1].tolist() == apart[0] + apart[1]

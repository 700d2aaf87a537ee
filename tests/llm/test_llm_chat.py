"""Replay of event logs, and round trips of formatted conversations."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumeria.llm import chat

EVENTS = "conv_id long, slot long, seq long, op string, role string, text string, formatted string"
ROWS = "conv_id long, turn long, role string, text string, slot string"
TRICKY = ["<s>", "</s>", "[INST]", "[/INST]", "</s>\n", "\\", "\\0", "\\1s>", "\n", "<", "[", "é漢😀", " ", "a", "</", "s>"]


def events(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENTS)


def brute(rows):
    """The messages by replaying events one by one."""
    out = {}
    for conv, slot, seq, op, role, text in sorted(set(rows), key=lambda r: (r[2], r[3], r[4] or "", r[5] or "")):
        slots = out.setdefault(conv, {})
        if op == "regenerate":
            for later in [s for s in slots if s > slot]:
                del slots[later]
        old_role, old = slots.get(slot, ("", ""))
        slots[slot] = (role if role is not None else old_role, "" if op == "regenerate" else (old if op == "delta" else "") + (text or ""))
    return {(c, s, *m) for c, slots in out.items() for s, m in slots.items()}


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "one "), (1, 1, 4, "delta", None, "two"),
        (1, 2, 5, "message", "user", "why"), (1, 3, 6, "message", "assistant", "so"), (1, 1, 7, "regenerate", None, None), (1, 1, 8, "delta", None, "new "),
        (1, 1, 9, "delta", None, "text"), (1, 2, 10, "message", "user", "ok"), (1, 0, 11, "edit", None, "hello"), (1, 1, 9, "delta", None, "text"),
        (2, 0, 1, "delta", "user", "early"), (2, 0, 2, "edit", None, None), (2, 1, 3, "message", None, "x"), (2, 1, 4, "delta", "assistant", "y"),
        (3, 0, 1, "regenerate", None, None), (None, 0, 1, "message", "user", "no id"),
    ]
    found = {tuple(r) for r in chat.fold(events(spark, log)).collect()}
    assert found == brute(log)
    assert (1, 1, "assistant", "new text") in found and (1, 2, "user", "ok") in found and not any(r[:2] == (1, 3) for r in found)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "sys\ntem", "<s>"]), st.lists(st.sampled_from(TRICKY), max_size=6).map("".join)), max_size=12))
def test_formatting_loses_nothing(spark, turns):
    rows = [(conv, k, role, text) for k, (conv, role, text) in enumerate(turns)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    whole = chat.render(chat.fold(chat.message_events(frame)))
    for r in whole.collect():
        own = [(role, text) for conv, _, role, text in rows if conv == r.conv_id]
        assert r.formatted.count("</s>\n") == len(own) == r.formatted.count("<s>") and "[INST]" not in r.formatted
        assert [chat_plain(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans] == [t for role, t in own if role == "assistant"]
    back = {r.conv_id: r for r in chat.read_back(whole).collect()}
    for conv in {r[0] for r in rows}:
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [tuple(t) for t in back[conv].turns] == own
        assert back[conv].loss == [t for role, t in own if role == "assistant"]


def chat_plain(text):
    for code, plain in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = text.replace(code, plain)
    return text


def test_digests_with_nulls_repeats_and_no_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, None, "b"), (1, None, "assistant", "é😀"), (None, 0, "assistant", "x"), (2, 0, "user", "</s>[INST]")]
    found = {r.conv_id: r for r in chat.digests(spark.createDataFrame([(*r, "x") for r in rows], ROWS)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(found) == {1, 2, None, -1}
    assert (found[1].n_turns, found[1].turns_sha256) == (4, sha("assistant\né😀\nuser\n\n\nb\n\nb\n"))
    assert (found[1].loss_chars, found[1].loss_sha256) == (2, sha("é😀"))
    assert (found[2].loss_chars, found[2].loss_sha256, found[2].formatted_chars) == (0, sha(""), 9 + 4 + 10 + 2)
    assert (found[None].loss_chars, found[-1].loss_chars) == (1, 21)
    assert [r.conv_id for r in chat.digests(spark.createDataFrame([], ROWS)).collect()] == [-1]

"""Base spans against the plain expressions, what the field adds, and redaction."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from plumeria.llm import pii

#: The rules as their definition states them.
EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, pii_spans string"


def brute(text):
    out = []
    for kind, expression in EXPRESSIONS.items():
        for m in re.finditer(expression, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "255", "256", "0001", "+", "-", " ", "(", ")", "é", "4111111111111111", "4111 1111-1111 1111", "%", "\n", "x@y.z", "1.2.3.4"]), max_size=14).map("".join))
def test_base_spans_follow_the_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "a.b@c-" * 30_000):
        assert isinstance(pii.base_spans(text), list)


def card():
    digits = "4" + "".join(random.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def fixture():
    random.seed(6)
    word = lambda: random.choice("the of and in to über été casa".split())
    rows = []
    for k in range(400):
        found = {
            0: f"{word()}.{k}@mail{k % 9}.example.com",
            1: ".".join(str(random.randrange(256)) for _ in range(4)),
            2: card(),
            3: f"+1 ({random.randrange(200, 999)}) 555-{random.randrange(1000, 9999)}",
            4: f"version {k % 7}.{k % 5}",
            5: str(random.randrange(10**4, 10**15)),
        }[k % 6]
        rows.append((k, f"{word()} {word()} {found} {word()} {word()}", "x"))
    return rows


def test_field_adds_what_a_neighbour_hid(spark):
    rows = fixture()
    hidden = [(1000 + k, f"the of 77 {card()} and in", "x") for k in range(10)]
    clean = [(2000 + k, t, "x") for k, t in enumerate(("the of and", "in 1999 and 12 of 7", "version 2.0 of", "", None, "a@b", "x @ y 1"))]
    docs = spark.createDataFrame(rows + hidden + clean + [rows[0], rows[0]], SCHEMA)
    found = pii.digests(docs).collect()
    texts = {i: t or "" for i, t, _ in rows + hidden + clean}
    assert len(found) == len(rows) + len(hidden) + len(clean) + 2
    added = 0
    for r in found:
        base = brute(texts[r.doc_id])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        extra = set(spans) - set(base)
        if 1000 <= r.doc_id < 2000:
            added += extra == {("card", 10, 26)}
        if r.doc_id >= 2000:
            assert not spans
    assert added >= 8


def test_redaction_keeps_all_other_characters(spark):
    text = "é a@b.co, 1.2.3.4! +1 (900) 555-2077é"
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "no data", "x"), (1, text, "x")]
    made = pii.redact(spark.createDataFrame(rows, SCHEMA).drop("pii_spans").withColumn("extra", pii.F.lit(1)))
    assert made.columns == ["doc_id", "text", "extra"]
    assert sorted((r.doc_id, r.text) for r in made.collect() if r.text is not None) == [(1, "é [EMAIL], [IP]! [PHONE]é")] * 2 + [(3, ""), (4, "no data")]
    assert pii.redact(made.limit(0)).collect() == []


def test_segmentation_is_the_best_of_all():
    """Dynamic programming against listing all segmentations of a short zone."""
    random.seed(9)
    field = pii.Field()
    field.weights[:] = pii.np.random.default_rng(1).normal(size=field.weights.shape)
    field.steps[:] = pii.np.random.default_rng(2).normal(size=field.steps.shape)
    (zone,) = pii.zones("12.34 5678")
    score, n = field.scores(zone), len(zone.cuts) - 1

    def ways(at):
        if at == n:
            yield []
        for k in range(len(zone.first)):
            if zone.first[k] == at:
                for state in range(pii.STATES):
                    if score[k, state] > -pii.np.inf:
                        yield from ([(k, state), *rest] for rest in ways(zone.after[k]))

    value = lambda w: sum(score[k, s] for k, s in w) + sum(field.steps[a[1], b[1]] for a, b in zip(w, w[1:]))
    every = list(ways(0))
    best = max(every, key=value)
    assert field.best(zone) == [(zone.first[k], zone.after[k], s) for k, s in best if s]
    share, total, _ = field.chances(zone)
    assert pii.np.isclose(total, pii.np.logaddexp.reduce([value(w) for w in every]))
    k, s = best[0]
    assert pii.np.isclose(share[k, s], sum(pii.np.exp(value(w) - total) for w in every if (k, s) in w))

r"""Personal data by fixed rules and a semi-Markov conditional random field.

The rules find the base spans of four kinds, each kind by itself, leftmost first. They
judge a whole match at once and drop it if it fails, so a number or address that touches
other digits is lost. The field looks at such places again: the words that hold a digit or
an at sign, cut into atoms (runs of letters and digits, single other characters), are read
as a sequence of segments. A segment of at most 24 atoms is scored as a whole by its shape,
digits, checksum and neighbours, and by the kind of the segment before it; dynamic
programming chooses boundaries and kinds together. Base spans always stay; segments that the
field finds beside them are added.

Weights are fitted on a bounded sample of texts with base spans as truth (`sample_rows` in
expectation, by a hash of the text), by stochastic gradients of the conditional likelihood
over all segmentations; each span is also shown beside a short number, which is no part of
it. Finding reads every whole text, each row by itself; offsets are code
points.

A null or empty text has no spans. Repeated rows get equal spans. Overlapping base spans of
different kinds all stay. A model without examples adds nothing. Tables may hold further
columns; the columns that are added replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumeria.llm.frames import by_chunk
from plumeria.llm.words import text_bytes

#: Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_ROWS = 1500
EPOCHS = 3
RATE = 0.3
MOST_ATOMS = 24
PLACES = 1 << 13
#: Kinds of segments: none, then KINDS.
STATES = 1 + len(KINDS)
#: A segment is added if the field gives it this share of all segmentations.
LEAST_CHANCE = 0.9

_ZONE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)*")
_ATOM = re.compile(r"[A-Za-z0-9]+|.", re.DOTALL)
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT_RUN, _LETTER_RUN = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+")
_INSIDE = re.compile(r"[A-Za-z0-9@.%_+() -]*")
_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[48:58] = _TRIGGER[64] = True

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each at sign to the left as far as a local part reaches, to the right as far as a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the rules, by kind and then start."""
    found = list(emails(text))
    for run in DOTTED.finditer(text):
        # A run of dotted numbers is read four at a time.
        parts = list(_DIGIT_RUN.finditer(run.group()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(p.group().lstrip("0")) < 4 and int(p.group().lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                found.append(("ip", run.start() + parts[k].start(), run.start() + parts[k + 3].end()))
    for run in DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", run.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *run.span()))
    for run in PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", run.group())) <= 15:
            found.append(("phone", *run.span()))
    return found


@dataclass(frozen=True)
class Zone:
    """Atoms as offsets, and the candidate segments as (first atom, atom after the last, places of their features)."""

    cuts: list[int]
    first: np.ndarray
    after: np.ndarray
    places: np.ndarray


def _place(*parts: object) -> int:
    return crc32("\x1f".join(map(str, parts)).encode()) % PLACES


def _near(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else " "
    return "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c


def _features(text: str, start: int, end: int) -> list[int]:
    """Places of the features of a whole span; every span has equally many."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    shape = _LETTER_RUN.sub("a", _DIGIT_RUN.sub("9", span))
    shape = re.sub(r"(?:[a9._%+-]*)@", "a@", shape) if "@" in shape else shape
    parts = span.split(".")
    small = all(len(p) < 4 and p.isdigit() and int(p) <= 255 for p in parts)
    n = len(digits) if len(digits) < 24 else 24
    left, right = _near(text, start - 1), _near(text, end)
    card = n if 16 <= n <= 19 and luhn(digits) else 0
    return [
        _place("shape", shape[:40]), _place("digits", n), _place("parts", len(parts), small), _place("card", card > 0),
        _place("left", left), _place("right", right), _place("plus", span[:1] == "+", 8 <= n <= 15), _place("at", span.count("@"), "." in span.partition("@")[2]),
        _place("card shape", card > 0, shape == "9"), _place("bias"),
    ]


def zones(text: str) -> Iterator[Zone]:
    """The places of a text that the field reads."""
    for run in _ZONE.finditer(text):
        start, end = run.span()
        atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
        cuts = [a for a, _ in atoms] + [end]
        rows = []
        for i in range(len(atoms)):
            # Each atom may stand outside of any span.
            rows.append((i, i + 1, 0, [_place("out", _near(text, cuts[i])), *[_place("no")] * 9]))
            if not (text[cuts[i]] in LOCAL or text[cuts[i]] == "("):
                continue
            for j in range(i + 1, min(len(atoms), i + MOST_ATOMS) + 1):
                a, b = cuts[i], cuts[j]
                last = text[cuts[j - 1]]
                if not (last in LOCAL or last in "@() "):
                    break
                if not last.isalnum() or not last.isascii():
                    continue
                digits = sum(map(str.isdigit, text[a:b])) if b - a < 64 else 64
                if "@" in text[a:b] or digits >= 4:
                    rows.append((i, j, 1, _features(text, a, b)))
        yield Zone(cuts, *(np.array(x) for x in ([r[0] for r in rows], [r[1] for r in rows], [[*r[3], r[2]] for r in rows])))


def _grouped(atoms: np.ndarray, n: int) -> list[np.ndarray]:
    """For each atom from 0 to n, the segments that it begins or ends."""
    order = np.argsort(atoms, kind="stable")
    edges = np.searchsorted(atoms[order], np.arange(n + 2))
    return [order[edges[k] : edges[k + 1]] for k in range(n + 1)]


class Field:
    """Weights by place and kind, and by the kinds of neighbouring segments."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None) -> None:
        self.weights = np.zeros((PLACES, STATES)) if weights is None else weights
        self.steps = np.zeros((STATES, STATES)) if steps is None else steps

    def scores(self, zone: Zone) -> np.ndarray:
        """Of each segment and kind; single atoms outside have kind 0 only, other segments all but 0."""
        out = self.weights[zone.places[:, :-1]].sum(axis=1)
        inside = zone.places[:, -1] == 1
        out[inside, 0] = -np.inf
        out[~inside, 1:] = -np.inf
        return out

    def chances(self, zone: Zone) -> tuple[np.ndarray, float, np.ndarray]:
        """Of each segment and kind over all segmentations; the log of their sum; chances of neighbouring kinds."""
        score, n = self.scores(zone), len(zone.cuts) - 1
        ends, begins = _grouped(zone.after, n), _grouped(zone.first, n)
        ahead, behind = np.full((n + 1, STATES), -np.inf), np.full((n + 1, STATES), -np.inf)
        entered = np.full((n + 1, STATES), -np.inf)
        entered[0] = 0
        for k in range(1, n + 1):
            ahead[k] = np.logaddexp.reduce(entered[zone.first[ends[k]]] + score[ends[k]], axis=0)
            entered[k] = np.logaddexp.reduce(ahead[k][:, None] + self.steps, axis=0)
        behind[n] = 0
        left = np.full((n + 1, STATES), -np.inf)
        for k in range(n - 1, -1, -1):
            left[k] = np.logaddexp.reduce(score[begins[k]] + behind[zone.after[begins[k]]], axis=0)
            behind[k] = np.logaddexp.reduce(self.steps + left[k][None, :], axis=1)
        total = np.logaddexp.reduce(ahead[n])
        share = np.exp(entered[zone.first] + score + behind[zone.after] - total)
        step = sum((np.exp(ahead[k][:, None] + self.steps + left[k][None, :] - total) for k in range(1, n)), np.zeros((STATES, STATES)))
        return share, float(total), step

    def best(self, zone: Zone) -> list[tuple[int, int, int]]:
        """The likeliest segmentation: (first atom, atom after the last, kind) of the segments with a kind."""
        score, n = self.scores(zone), len(zone.cuts) - 1
        value, back = np.full((n + 1, STATES), -np.inf), {}
        entered, came = np.zeros((n + 1, STATES)), np.zeros((n + 1, STATES), dtype=int)
        ends = _grouped(zone.after, n)
        for k in range(1, n + 1):
            at = ends[k]
            reach = entered[zone.first[at]] + score[at]
            pick = reach.argmax(axis=0)
            value[k] = reach[pick, range(STATES)]
            back[k] = at[pick]
            joined = value[k][:, None] + self.steps
            entered[k], came[k] = joined.max(axis=0), joined.argmax(axis=0)
        out, k, state = [], n, int(value[n].argmax())
        while k:
            segment = back[k][state]
            first = int(zone.first[segment])
            if state:
                out.append((first, k, state))
            state, k = (int(came[first][state]) if first else 0), first
        return out[::-1]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field is sure of and that touch no base span."""
        taken, out = sorted((s, e) for _, s, e in base), []
        for zone in zones(text):
            if not (zone.places[:, -1] == 1).any():
                continue
            found = [x for x in self.best(zone) if not any(s < zone.cuts[x[1]] and zone.cuts[x[0]] < e for s, e in taken)]
            if found:
                share = self.chances(zone)[0]
                for first, after, kind in found:
                    at = np.flatnonzero((zone.first == first) & (zone.after == after) & (zone.places[:, -1] == 1))
                    if share[at, kind].max(initial=0) >= LEAST_CHANCE:
                        out.append((KINDS[kind - 1], zone.cuts[first], zone.cuts[after]))
        return out


def _beside_a_number(text: str, span: Span) -> tuple[str, list[Span]]:
    """A span with a short number before or after it, which the rules would read as a part of it."""
    kind, start, end = span
    digest = crc32(text[start:end].encode())
    number = str(digest % 10 ** (1 + digest % 4)) + "- "[digest >> 9 & 1]
    if digest >> 10 & 1:
        return text[start:end] + number[::-1], [(kind, 0, end - start)]
    return number + text[start:end], [(kind, len(number), len(number) + end - start)]


def _doubtful(text: str, zone: Zone, spans: list[Span]) -> bool:
    """Whether a segment beside the spans would be one by itself: such places teach nothing."""
    for first, after in zip(zone.first[zone.places[:, -1] == 1], zone.after[zone.places[:, -1] == 1]):
        start, end = zone.cuts[first], zone.cuts[after]
        if not any(s < end and start < e for _, s, e in spans) and any(e - s == end - start for _, s, e in base_spans(text[start:end])):
            return True
    return False


def _truth(zone: Zone, spans: list[Span]) -> list[tuple[int, int]] | None:
    """The zone's true segments and kinds, if its spans are candidates that don't overlap."""
    inside = sorted((s, e, k) for k, s, e in spans if zone.cuts[0] <= s < zone.cuts[-1])
    by_cut = {c: k for k, c in enumerate(zone.cuts)}
    index = {(int(a), int(b), int(c)): k for k, (a, b, c) in enumerate(zip(zone.first, zone.after, zone.places[:, -1]))}
    out, at = [], 0
    for start, end, kind in inside:
        key = (by_cut.get(start, -1), by_cut.get(end, -1), 1)
        if key not in index or key[0] < at:
            return None
        out += [(index[k, k + 1, 0], 0) for k in range(at, key[0])] + [(index[key], 1 + KINDS.index(kind))]
        at = key[1]
    return out + [(index[k, k + 1, 0], 0) for k in range(at, len(zone.cuts) - 1)]


def _learn(table: pa.Table) -> pa.Table:
    """Fits the sample, in the order of its hashes, with a step size for each weight."""
    field, examples = Field(), []
    for whole in table.sort_by([("_order", "ascending"), ("text", "ascending")]).column("text").to_pylist():
        found = base_spans(whole)
        for text, spans in [(whole, found), *(_beside_a_number(whole, s) for s in found)]:
            for zone in zones(text):
                # Long zones say nothing new; their gradient takes long.
                if len(zone.cuts) > 4 * MOST_ATOMS or text is whole and _doubtful(text, zone, spans):
                    continue
                if (truth := _truth(zone, spans)) is not None:
                    examples.append((zone, truth))
    seen, seen_steps = np.full_like(field.weights, 1e-8), np.full_like(field.steps, 1e-8)
    for _ in range(EPOCHS):
        for zone, truth in examples:
            share, _, step = field.chances(zone)
            share, step = -share, -step
            for (segment, kind), after in zip(truth, [*truth[1:], None]):
                share[segment, kind] += 1
                if after:
                    step[kind, after[1]] += 1
            places = zone.places[:, :-1]
            at, inverse = np.unique(places, return_inverse=True)
            slope = np.zeros((len(at), STATES))
            np.add.at(slope, inverse.reshape(places.shape), share[:, None, :])
            seen[at] += slope**2
            field.weights[at] += RATE * slope / np.sqrt(seen[at])
            seen_steps += step**2
            field.steps += RATE * step / np.sqrt(seen_steps)
    values = np.concatenate([field.weights.reshape(-1), field.steps.reshape(-1)]) if examples else np.zeros(0)
    kept = np.flatnonzero(values)
    return pa.table({"place": pa.array(kept, pa.int64()), "weight": pa.array(values[kept], pa.float64())})


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field | None:
    """Fits on a sample of the texts that hold a digit or an at sign; None without any."""
    texts = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    total = texts.count()
    draw = F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(1 << 40))
    sample = texts.withColumn("_order", draw).where(F.col("_order") < F.lit(int(min(1.0, sample_rows / max(1, total)) * (1 << 40))))
    # Copies of a text count once; so the one task of the descent is bounded by the sample.
    sample = sample.dropDuplicates(["_order"])
    found = sample.groupBy(F.lit(0).alias("_all")).applyInArrow(_learn, "place long, weight double").toArrow()
    if not found.num_rows:
        return None
    values = np.zeros(PLACES * STATES + STATES * STATES)
    values[np.asarray(found.column("place"))] = np.asarray(found.column("weight"))
    return Field(values[: PLACES * STATES].reshape(PLACES, STATES), values[PLACES * STATES :].reshape(STATES, STATES))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, field: Field | None, name: str = "pii_spans") -> DataFrame:
    """The documents with their spans (kind, start, end, base) by kind and start; `base` tells the rules' own."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.drop(name)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text")
        data, offsets = text_bytes(texts)
        seen = np.concatenate(([0], np.cumsum(_TRIGGER[data])))
        out: list[list] = [[] for _ in range(part.num_rows)]
        for k in np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]]):
            text = texts[int(k)].as_py()
            base = base_spans(text)
            extra = shared.value.added(text, base) if shared.value else []
            rows = [(*s, True) for s in base] + [(*s, False) for s in extra]
            rows.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
            out[k] = [dict(zip(("kind", "start", "end", "base"), r)) for r in rows]
        return part.append_column(name, pa.array(out, kind))

    return docs.mapInArrow(by_chunk(work), T.StructType([*docs.schema.fields, T.StructField(name, _SPANS)]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    found = find(docs.select("doc_id", "text"), fit(docs))
    base = F.filter("pii_spans", lambda s: s["base"])

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span's characters replaced by its kind in brackets; overlapping spans become one, by the first."""
    spans = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("done"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (state["done"] + 1).cast("int"), F.greatest(s["start"] - state["done"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= state["done"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["text"], mark).alias("text"), F.greatest(state["done"], s["end"]).alias("done"))

    found = find(docs, fit(docs))
    made = F.aggregate(spans, start, step, lambda s: F.concat(s["text"], F.substr(F.col("text"), (s["done"] + 1).cast("int"), F.length("text"))))
    return found.withColumn("text", F.when(F.size("pii_spans") > 0, made).otherwise(F.col("text"))).select(*docs.columns)

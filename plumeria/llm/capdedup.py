"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

A filter is a direction; a vector belongs to all filters whose direction it exceeds a
threshold with. Directions are a product code: the dimensions are cut into blocks, each
block has its own random codewords, and a filter is one codeword per block, so a few
codewords make very many filters. A vector is list-decoded: block by block, partial sums
that can no longer reach the threshold are dropped, which yields exactly the filters above
it. Vectors that share a filter, and label and dimension, are compared by cosine in double
precision.

The number of filters grows with the number of vectors, so a filter holds about as many
unrelated vectors at any size; the threshold gives a vector `FILTERS` of them on average in
each of `CODES` independent codes for every block of a code above one, as more blocks find fewer
of the close pairs. A vector that no filter of a code reaches gets the best few of that code.
Close vectors miss each other only if they share none in any code (recall is measured in the tests, for two and three blocks).

Equal vectors of one label form a class and are compared as one. A pair is judged in the
first filter that both share, so links are counted once without writing pairs; a filter with
many vectors is cut into parts, and every two parts are a block for a task of its own.

Vectors that are null, empty, zero or hold null or non-finite numbers, and vectors without a
label, link with nothing. Repeated rows are copies. A null id is larger than any; a component
of nulls only has a null component_id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.components import components
from plumeria.session import cut_lineage

THRESHOLD = 0.98
#: Codes, each over another order of the dimensions: the number of filters of a vector varies
#: with its norms in a code's blocks, so no single code suits all vectors. A code of three blocks has twice as many.
CODES = 8
#: Filters of a vector in a code, on average; unrelated vectors of a label that a filter holds.
FILTERS = 6
LOAD = 0.125
LEAST_FILTERS = 1 << 14
MOST_CODEWORDS = 1 << 11
SEED = 20160101
BLOCK_VECTORS = 512
DECODED = 256
COMPARED = 1 << 15


def block_count(dimension: int, filters: int) -> int:
    blocks = 1
    while filters ** (1 / blocks) > MOST_CODEWORDS and blocks < dimension:
        blocks += 1
    return min(max(blocks, 2), dimension)


def codewords(dimension: int, filters: int, seed: int = SEED) -> list[np.ndarray]:
    """Codewords of each block, as few blocks as keep a block's codewords few; all filters have length 1."""
    blocks = block_count(dimension, filters)
    each = max(2, math.ceil(filters ** (1 / blocks)))
    random = np.random.default_rng([seed, dimension, each])
    out = []
    for part in np.array_split(np.arange(dimension), blocks):
        words = random.standard_normal((each, len(part)))
        out.append(words / np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(len(part) / dimension))
    return out


def cap_threshold(dimension: int, code: list[np.ndarray], filters: float, seed: int = SEED) -> float:
    """The threshold that random unit vectors exceed with `filters` of the code's directions on average.

    Found by bisection over the expected number, from the block scores of random vectors.
    """
    random = np.random.default_rng([seed, dimension, 1])
    x = random.standard_normal((64, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    low, high = 0.0, 1.0
    for _ in range(24):
        middle = (low + high) / 2
        if len(decode(x, code, middle, most=filters * len(x))[0]) > filters * len(x):
            low = middle
        else:
            high = middle
    return high


def decode(x: np.ndarray, code: list[np.ndarray], threshold: float, most: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all filters that unit vectors exceed, sorted; stops early once there are over `most`."""
    scores, at = [], 0
    for words in code:
        scores.append(x[:, at : at + words.shape[1]] @ words.T)
        at += words.shape[1]
    ahead = np.zeros((len(code) + 1, len(x)))
    for k in range(len(code) - 1, -1, -1):
        ahead[k] = ahead[k + 1] + scores[k].max(axis=1)
    rows, sums, filters = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
    for k, score in enumerate(scores):
        out = ([], [], [])
        found = 0
        for start in range(0, len(rows), DECODED):
            r, s, f = (v[start : start + DECODED] for v in (rows, sums, filters))
            reach = s[:, None] + score[r]
            i, j = np.nonzero(reach + ahead[k + 1][r][:, None] >= threshold)
            for v, got in zip(out, (r[i], reach[i, j], f[i] * score.shape[1] + j)):
                v.append(got)
            found += len(i)
            if k == len(scores) - 1 and found > most:
                break
        rows, sums, filters = (np.concatenate(v) if v else np.zeros(0, dtype=t) for v, t in zip(out, (np.int64, float, np.int64)))
    return rows, filters


def best_filters(x: np.ndarray, code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all filters made of the best two codewords of each block."""
    filters, at = np.zeros((len(x), 1), dtype=np.int64), 0
    for words in code:
        best = np.argsort(-(x[:, at : at + words.shape[1]] @ words.T), axis=1, kind="stable")[:, :2]
        filters = (filters[:, :, None] * len(words) + best[:, None, :]).reshape(len(x), filters.shape[1] * best.shape[1])
        at += words.shape[1]
    return np.repeat(np.arange(len(x)), filters.shape[1]), filters.reshape(-1)


def _codes(dimension: int, filters: int) -> list[tuple[np.ndarray, list[np.ndarray], float]]:
    return [_code(dimension, filters, k) for k in range(CODES * max(1, block_count(dimension, filters) - 1))]


def filters_of(unit: np.ndarray, codes: list[tuple[np.ndarray, list[np.ndarray], float]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of unit vectors over all codes, sorted; every vector has some of each code."""
    rows, found = [], []
    for k, (order, code, threshold) in enumerate(codes):
        r, f = decode(unit[:, order], code, threshold)
        without = np.setdiff1d(np.arange(len(unit)), r)
        best, g = best_filters(unit[without][:, order], code)
        rows += [r, without[best]]
        found += [f + (k << 48), g + (k << 48)]
    rows, found = np.concatenate(rows), np.concatenate(found)
    sort = np.lexsort((found, rows))
    return rows[sort], found[sort]


def _code(dimension: int, filters: int, number: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """The order of dimensions of a code, its codewords and its threshold."""
    code = codewords(dimension, filters, SEED + number)
    order = np.random.default_rng([SEED, dimension, 2, number]).permutation(dimension)
    return order, code, cap_threshold(dimension, code, FILTERS)


def _decoded(filters: int):
    """Each class with its unit vector and the sorted list of its filters."""
    schema = pa.schema([("label", pa.int64()), ("dimension", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("filters", pa.list_(pa.int64()))])
    codes: dict[int, list[tuple[np.ndarray, list[np.ndarray], float]]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values, dtype=np.float64) for v in batch.column("embedding")]
            sizes = np.array([len(v) for v in vectors])
            for dimension in np.unique(sizes).tolist():
                if dimension not in codes:
                    codes[dimension] = _codes(dimension, filters)
                own = np.flatnonzero(sizes == dimension)
                for start in range(0, len(own), DECODED):
                    at = own[start : start + DECODED]
                    raw = np.stack([vectors[k] for k in at])
                    # Scaled first: squares of large or small numbers would not be finite or not be zero.
                    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    rows, found = filters_of(unit, codes[dimension])
                    ends = pa.array(np.searchsorted(rows, np.arange(len(at) + 1)), pa.int32())
                    take = pa.array(at)
                    columns = [
                        batch.column("label").take(take), pa.array(np.full(len(at), dimension), pa.int32()), batch.column("node").take(take),
                        batch.column("copies").take(take), pa.array([x.tobytes() for x in unit], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(found)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _compare(threshold: float):
    """Of rows sorted by block: links of each vector, weighted by copies, and edges that span what is linked."""

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All blocks of a table at once; pairs are formed by position, block by block, in bounded numbers."""
        keys = [np.asarray(table.column(c)) for c in ("label", "dimension", "filter", "row", "col")]
        n = table.num_rows
        new = np.ones(n, dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        nodes, copies, part = (np.asarray(table.column(c)) for c in ("node", "copies", "part"))
        vectors, lists = table.column("vector").combine_chunks(), table.column("filters").combine_chunks()
        # Position k is paired with those after it in its block.
        start = np.repeat(first, size)
        later = start + np.repeat(size, size) - np.arange(n) - 1
        ends = np.cumsum(later)
        one, two = [], []
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COMPARED, side="right")))
            left = np.repeat(np.arange(a, b), later[a:b])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
            # In a block of two parts only pairs across them; in one of one part all.
            across = (keys[3][left] == keys[4][left]) | (part[left] != part[right])
            left, right = left[across], right[across]
            for dimension in np.unique(keys[1][left]).tolist():
                own = keys[1][left] == dimension
                used, at = np.unique(np.concatenate((left[own], right[own])), return_inverse=True)
                x = np.frombuffer(b"".join(vectors[int(k)].as_buffer() for k in used), dtype=np.float64).reshape(-1, dimension)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                i, j = at[: own.sum()], at[own.sum() :]
                close = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                one.append(left[own][close])
                two.append(right[own][close])
            a = b
        left, right = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (one, two))
        sets = {int(k): np.asarray(lists[int(k)].values) for k in np.unique(np.concatenate((left, right)))}
        keep = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True)[0] == keys[2][i] for i, j in zip(left.tolist(), right.tolist())], dtype=bool)
        left, right = left[keep], right[keep]
        found, at = np.unique(nodes, return_inverse=True)
        links = (np.bincount(at[left], copies[right], len(found)) + np.bincount(at[right], copies[left], len(found))).astype(np.int64)
        roots = np.arange(len(found))

        def root(k: int) -> int:
            while roots[k] != k:
                roots[k] = roots[roots[k]]
                k = roots[k]
            return k

        for i, j in zip(at[left].tolist(), at[right].tolist()):
            i, j = root(i), root(j)
            if i != j:
                roots[max(i, j)] = min(i, j)
        pick = links > 0
        joined = found[[root(k) for k in np.flatnonzero(pick)]] if pick.any() else found[:0]
        yield pa.RecordBatch.from_arrays([pa.array(found[pick]), pa.array(joined), pa.array(links[pick])], ["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last block may go on in the next batch.
            last = [table.column(c)[-1].as_py() for c in ("label", "dimension", "filter", "row", "col")]
            cut = table.num_rows - 1
            while cut and [table.column(c)[cut - 1].as_py() for c in ("label", "dimension", "filter", "row", "col")] == last:
                cut -= 1
            if cut:
                yield from judge(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from judge(held)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    usable = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0))))
    classes = rows.where(F.col("embedding").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    filters = max(LEAST_FILTERS, 1 << math.ceil(math.log2(max(1.0, n * FILTERS / LOAD))))
    decoded = classes.select("label", "node", "copies", "embedding").mapInArrow(
        _decoded(filters), "label long, dimension int, node long, copies long, vector binary, filters array<bigint>"
    )
    decoded = cut_lineage(decoded)
    key = ["label", "dimension", "filter"]
    posted = decoded.select("label", "dimension", F.explode("filters").alias("filter"), "node")
    # Only filters with more than one vector matter; only large ones are cut.
    sizes = posted.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1")
    parts = posted.join(sizes.select(*key, F.ceil(F.col("m") / BLOCK_VECTORS).cast("long").alias("parts")), key)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = parts.select(*key, F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"), "part", "node")
    # Vectors travel only where there is something to compare them to.
    blocks = blocks.join(decoded.select("node", "copies", "vector", "filters"), "node")
    order = [*key, "row", "col"]
    judged = blocks.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_compare(threshold), "u long, v long, links long")
    judged = cut_lineage(judged)
    links = judged.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    found = components(judged.select("u", "v"))
    per_class = classes.join(found, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = per_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = per_class.join(least, "component").select(
        "label", "embedding", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    linked = rows.where(F.col("embedding").isNotNull()).join(per_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

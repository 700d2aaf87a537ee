"""Jaccard join of documents by their 5-word shingles: a size-aware heavy-light join.

Documents with equal sets form one class and are joined as one. Two different classes link
when 4 * |A and B| >= 3 * |A or B|; then they share at least three quarters of either set.
All sets follow one global order, rare shingles first as far as counts tell. If at least o
of a set's s shingles must be shared, two linked sets share k of the first s - o + k (any k).

- Light sets are small: each of the fixed-size subsets (pairs, k = 2) of such a prefix is a key.
- Heavy sets are large: each shingle of their prefix (k = 1 + s // 16) is a key, and the
  inverted lists are scanned; a set with fewer than k keys on lists of several sets is linked
  to none. Light sets near the boundary take part, as heavy ones may link to them.
- The boundary is the size at which the summed cost of either side is least, by the numbers
  of sets of each size and the mean length of a list.

Lists are scanned without forming all pairs. In each list one member, chosen by a hash
(six in a long list), is paired with the others; pairs that share k lists are verified on the whole sets. Members that
are joined by then, in whatever list, need no further comparison with each other, so the lists
that matter shrink fast; once they don't, the members of long lists are cut into parts of
bounded size, and every two parts are compared as a block in one task, which hands on only
links that join components. Of shorter lists the pairs left across different components are
counted as they stand, and those that share k lists verified. Nothing is skipped: a pair is
left out only if both are known to be in one component, or share too few keys to be linked. Links between the members of a component are counted afterwards, in blocks of
bounded size, without writing pairs.

Sets travel as sorted 64-bit fingerprints of shingles, and a class is known by the 64-bit
fingerprint of its set.

Nulls and empty texts: no words, no shingles, size 0, linked with nothing. Texts of one to
four words are their whole sequence. Repeated rows are copies of each other. A null id is
larger than any; a component of nulls only has a null component_id. Ties: the least id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumeria.llm.components import components
from plumeria.llm.frames import bounded_broadcast, by_chunk
from plumeria.llm.words import chunks, mix, shingle_hashes, word_hashes
from plumeria.session import cut_lineage

#: Shingles that many classes share go last in the global order; at most so many are broadcast.
MOST_COMMON = 1 << 20
LEAST_COMMON = 32
#: A task reports the shingles that it has seen in so many classes.
REPORTED = 3
#: Sizes up to this are weighed as light.
LIGHT_SIZES = 64
BUCKET_KEYS = 2_500_000
LEAST_BUCKETS = 8
HELD_KEYS = 1 << 20
ROUNDS = 6
#: No more hubs are tried once pairs are at most so many for each key, or a round leaves more than this share of them: a round has some forty shuffles.
PAIRS_PER_KEY = 2
LEFT = 0.4
#: Members that a longer list's others are paired with at once, so that large groups join up in few rounds.
LONG_LIST, LONG_LIST_HUBS = 64, 6
#: Of lists longer than this the pairs are compared in blocks, never written.
BLOCK_LIST = 128
BLOCK_SETS = 512
PRUNINGS = 2
BLOCK_SHINGLES = 250_000
#: Columns of a block's incidence matrix that are multiplied at once.
COLUMNS = 4096
_CLASS, _SUBSET = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9)


def needed(size: np.ndarray | int) -> np.ndarray | int:
    """Shingles of a set of this size that a linked set shares at least."""
    return -(-3 * size // 4)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and shingle of every set's members, sorted; where each row begins."""
    words, starts = word_hashes(texts)
    shingles, at = shingle_hashes(words, starts)
    rows = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    rows, shingles = rows[first], shingles[first]
    return rows, shingles, np.searchsorted(rows, np.arange(len(texts) + 1))


def class_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's set; 0 for empty ones."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingles ^ _CLASS))))
    sizes = np.diff(starts)
    made = mix(total[starts[1:]] - total[starts[:-1]] + sizes.astype(np.uint64)) | np.uint64(1)
    return np.where(sizes > 0, made, np.uint64(0)).view(np.int64)


def shared_keys(size: Column | np.ndarray) -> Column | np.ndarray:
    """Shingles that a set's prefix is made to share with every linked set at least as large."""
    return 1 + size // 16 if isinstance(size, np.ndarray) else 1 + F.floor(size / 16)


class Seen:
    """Classes that a task has met; says which rows are the first of their class."""

    def __init__(self) -> None:
        self.classes: set[int] = set()

    def new(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), dtype=bool)
        for k, node in enumerate(nodes.tolist()):
            if node and node not in self.classes:
                self.classes.add(node)
                out[k] = True
        return out


def _describe(id_type: pa.DataType):
    """Of every row: id, class and size. Of the task: shingles that several of its classes share."""
    schema = pa.schema([("doc_id", id_type), ("_text", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("common", pa.int64()), ("times", pa.int64())])

    def common(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = Seen(), [], 0

        def report() -> pa.RecordBatch:
            found, times = common(held, REPORTED)
            pick = times >= REPORTED
            n = int(pick.sum())
            nulls = [pa.nulls(n, f.type) for f in list(schema)[:4]]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(found[pick].view(np.int64)), pa.array(times[pick], pa.int64())], schema=schema)

        for batch in batches:
            for part in chunks(batch, "text"):
                rows, shingles, starts = shingle_sets(part.column("text"))
                nodes = class_hashes(shingles, starts)
                held.append(shingles[seen.new(nodes)[rows]])
                size += len(held[-1])
                columns = [part.column("doc_id"), part.column("_text"), pa.array(nodes), pa.array(np.diff(starts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int64())], schema=schema)
                if size >= HELD_KEYS:
                    yield report()
                    held.clear()
                    size = 0
        yield report()

    return run


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest light size: the one with the least summed cost, by the number of sets of each size."""
    best, cost = 0, 0.0
    low = cost
    for size in range(3, LIGHT_SIZES + 1):
        prefix = size - needed(size) + 1
        light, heavy = math.comb(prefix + 1, 2), prefix * (1 + mean_list)
        cost += sizes.get(size, 0) * (light - heavy)
        if cost < low:
            best, low = size, cost
    return best


def _keys(shingles: np.ndarray, starts: np.ndarray, rows: np.ndarray, common: np.ndarray, times: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of everything by which these sets are looked up."""
    where = np.minimum(np.searchsorted(common, shingles), max(len(common) - 1, 0))
    weight = np.where(common[where] == shingles, times[where], 0) if len(common) else np.zeros(len(shingles), dtype=np.int64)
    order = np.lexsort((shingles, weight, rows))
    shingles, rows = shingles[order], rows[order]
    place = np.arange(len(rows)) - starts[rows]
    sizes = np.diff(starts)
    prefix = sizes - needed(sizes) + shared_keys(sizes)
    single = (4 * sizes > 3 * light) & (sizes > 2)
    pick = single[rows] & (place < prefix[rows])
    out_rows, out = [rows[pick]], [mix(shingles[pick])]
    for size in np.unique(sizes[(sizes > 2) & (sizes <= light)]):
        own = np.flatnonzero(sizes == size)
        block = shingles[starts[own][:, None] + np.arange(size - needed(size) + 2)]
        first, second = np.triu_indices(block.shape[1], 1)
        out.append(mix(block[:, first] * _SUBSET + block[:, second]).reshape(-1))
        out_rows.append(np.repeat(own, len(first)))
    return np.concatenate(out_rows), np.concatenate(out)


def _post(buckets: int, light: int, shared):
    """Sends each class's keys to their buckets, packed; one row per bucket, not per key."""
    schema = pa.schema([("bucket", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            nodes, sizes, keys = (np.concatenate(x) for x in zip(*held))
            bucket = (keys >> shift).astype(np.int64)
            order = np.lexsort((nodes, bucket))
            nodes, sizes, keys, bucket = nodes[order], sizes[order], keys[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows: dict[str, list] = {c: [] for c in schema.names}
            for k in np.flatnonzero(np.diff(edges)):
                part = slice(edges[k], edges[k + 1])
                starts = np.flatnonzero(np.diff(nodes[part], prepend=nodes[part][0] - 1))
                rows["bucket"].append(int(k))
                rows["nodes"].append(nodes[part][starts].tobytes())
                rows["sizes"].append(sizes[part][starts].astype(np.uint32).tobytes())
                rows["counts"].append(np.diff(np.append(starts, len(nodes[part]))).astype(np.uint32).tobytes())
                # Within a bucket 32 further bits tell keys apart; what they confuse, verification undoes.
                rows["keys"].append((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        seen, held, size = Seen(), [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, shingles, starts = shingle_sets(part.column("text"))
                nodes, sizes = class_hashes(shingles, starts), np.diff(starts)
                pick = seen.new(nodes)[rows]
                rows, shingles = rows[pick], shingles[pick]
                starts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                rows, keys = _keys(shingles, starts, rows, common, times, light)
                held.append((nodes[rows], sizes[rows], keys))
                size += len(keys)
                if size >= HELD_KEYS:
                    yield from sent(held)
                    held.clear()
                    size = 0
        yield from sent(held)

    return run


def _lists(table: pa.Table) -> pa.Table:
    """The inverted lists of one bucket that have more than one class: key, node, n."""
    nodes, sizes, keys = [], [], []
    for row in zip(*(table.column(c) for c in ("nodes", "sizes", "counts", "keys"))):
        node, size, count, key = (np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(row, (np.int64, np.uint32, np.uint32, np.uint32)))
        nodes.append(np.repeat(node, count))
        sizes.append(np.repeat(size, count))
        keys.append(key)
    node, size, key = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(keys)
    order = np.lexsort((node, key))
    node, size, key = node[order], size[order], key[order]
    # A class that several tasks have met is there several times.
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    node, size, key = node[first], size[first], key[first]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    many = same[:-1] | same[1:]
    whole = key[many].astype(np.int64) | np.int64(table.column("bucket")[0].as_py() << 32)
    return pa.table({"key": pa.array(whole), "node": pa.array(node[many]), "n": pa.array(size[many].astype(np.int64))})


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, shingles, starts = shingle_sets(batch.column("text"))
    packed = pa.array([shingles[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(class_hashes(shingles, starts)), packed], ["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group, each group's hub first: the members that link to the hub."""
    hub = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k, (member, packed) in enumerate(zip(batch.column("member").to_pylist(), batch.column("shingles"))):
            own = np.frombuffer(packed.as_buffer(), dtype=np.uint64)
            if not member:
                # Copied, as the batch goes before the group's other members may come.
                hub = own.copy()
                continue
            both = int((own[np.minimum(np.searchsorted(own, hub), len(own) - 1)] == hub).sum())
            keep[k] = 4 * both >= 3 * (len(own) + len(hub) - both)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("node")], ["u", "v"]).filter(pa.array(keep))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link. Sets travel once per pair; a node with many pairs is cut into groups of its own."""
    groups_ = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("groups"))
    members = pairs.join(groups_, "u").select("u", F.pmod(F.xxhash64("v"), "groups").alias("group"), F.lit(1).alias("member"), F.col("v").alias("node"))
    hubs = groups_.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), F.lit(0).alias("member"), F.col("u").alias("node"))
    rows = cut_lineage(members.unionByName(hubs))
    rows = bounded_broadcast(rows, rows.count()).join(sets, "node")
    rows = rows.repartition("u", "group").sortWithinPartitions("u", "group", "member", "node")
    return rows.select("u", "member", "node", "shingles").mapInArrow(_linked, "u long, v long")


def _pruned(lists: DataFrame, light: int) -> DataFrame:
    """The lists without the heavy sets that share too few keys to be linked, and without lists of a single set.

    Who goes shortens lists, so it is done again.
    """
    for _ in range(PRUNINGS):
        enough = (F.max("n") <= light) | (F.count("*") >= shared_keys(F.ceil(3 * F.max("n") / 4)))
        kept = lists.groupBy("node").agg(enough.alias("enough")).where("enough").select("node")
        lists = lists.join(kept, "node")
        several = lists.groupBy("key").count().where("count > 1").select("key")
        lists = cut_lineage(lists.join(several, "key"))
    return lists


def _alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link at all."""
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & a.isNotNull()


def _enough(light: int, slack: int = 0) -> Column:
    """Whether a pair is on as many lists as linked sets of its sizes are."""
    need = F.when(F.max(F.greatest("n", "_n")) <= light, 1).otherwise(shared_keys(F.min(F.least("n", "_n"))) - slack)
    return F.count("*") >= need


def _hub_pairs(lists: DataFrame, round_: int, light: int) -> DataFrame:
    """Each list's members with one of them, or with some if it is long, chosen by hashes, as far as they are in other components."""
    def first(k: int) -> Column:
        order = F.xxhash64(F.lit(round_), F.lit(k), "node").alias("_order")
        return F.min(F.struct(order, F.col("node").alias("v"), F.col("n").alias("_n"), F.col("component").alias("_component")))

    several = F.when(F.count("*") > LONG_LIST, LONG_LIST_HUBS).otherwise(1)
    hubs = lists.groupBy("key").agg(F.slice(F.array(*map(first, range(LONG_LIST_HUBS))), 1, several).alias("hubs"))
    hubs = hubs.select("key", F.explode("hubs").alias("hub")).select("key", "hub.*").drop("_order")
    pairs = lists.join(hubs, "key").where((F.col("component") != F.col("_component")) & _alike(F.col("n"), F.col("_n")))
    pairs = pairs.groupBy(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).agg(_enough(light).alias("enough"))
    return pairs.where("enough").drop("enough")


def _left_over(lists: DataFrame) -> tuple[DataFrame, int, int]:
    """The lists that still span several components; their members, and the pairs across components."""
    per = lists.groupBy("key", "component").agg(F.count("*").alias("m"))
    open_ = per.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count("*").alias("parts")).where("parts > 1")
    left = cut_lineage(lists.join(open_.select("key", "m", "mm"), "key"))
    members, pairs = left.agg(F.count("*"), F.sum((F.col("m") * F.col("m") - F.col("mm")) / F.col("m") / 2)).first()
    return left.drop("m", "mm"), members, int(pairs or 0)


def _across(lists: DataFrame, light: int) -> DataFrame:
    """All pairs of different components that are on enough lists; one less, as two keys of a set may be taken for one."""
    other = lists.select("key", F.col("node").alias("v"), F.col("n").alias("_n"), F.col("component").alias("_component"))
    pairs = lists.join(other, "key").where((F.col("node") < F.col("v")) & (F.col("component") != F.col("_component")) & _alike(F.col("n"), F.col("_n")))
    return pairs.groupBy(F.col("node").alias("u"), "v").agg(_enough(light, 1).alias("enough")).where("enough").drop("enough")


def _long_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of long lists by cluster, and the other lists.

    Lists that have the same member chosen by a hash form a cluster: those of a group of near copies have mostly the same members.
    """
    chosen = F.min(F.struct(F.xxhash64("node").alias("_order"), F.col("node").alias("cluster")))
    long = cut_lineage(lists.groupBy("key").agg(F.count("*").alias("_m"), chosen.alias("_chosen")).where(F.col("_m") > BLOCK_LIST).select("key", "_chosen.cluster"))
    members = lists.join(long, "key").select("cluster", "node", "n", "component").distinct()
    return members, lists.join(long.select("key"), "key", "left_anti")


def _relabel(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of all links so far, and the lists with them."""
    found = components(links)
    lists = lists.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return found, lists


def _by_block(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Hands `work` the rows of each block, of rows sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            of = list(zip(*(table.column(c).to_pylist() for c in ("cluster", "row", "col"))))
            cuts = [0] + [k for k in range(1, len(of)) if of[k] != of[k - 1]]
            for a, b in zip(cuts, cuts[1:]):
                yield from work(table.slice(a, b - a))
            left = table.slice(cuts[-1])
        if left is not None and left.num_rows:
            yield from work(left)

    return run


def _block_links(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block that are of its first part, those of its second, and which of them link."""
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
    part = np.asarray(table.column("part"))
    row, col = table.column("row")[0].as_py(), table.column("col")[0].as_py()
    sizes = np.array([len(x) for x in sets])
    found, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[at]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    one, two = (np.flatnonzero(part == row), np.flatnonzero(part == col)) if row != col else (np.arange(len(sets)),) * 2
    both = np.zeros((len(one), len(two)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        incidence = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), dtype=np.float32)
        incidence[owner[a:b], column[a:b] - start] = 1
        both += incidence[one] @ incidence[two].T
    link = 4 * both >= 3 * (sizes[one][:, None] + sizes[two][None, :] - both)
    if row == col:
        np.fill_diagonal(link, False)
    return one, two, link


def _count_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each class, the copies of the classes that it links to in this block."""
    one, two, link = _block_links(table)
    nodes, copies = (np.asarray(table.column(c)) for c in ("node", "copies"))
    out = np.zeros(len(nodes), dtype=np.int64)
    out[one] += link @ copies[two]
    if table.column("row")[0].as_py() != table.column("col")[0].as_py():
        out[two] += link.T @ copies[one]
    pick = out > 0
    yield pa.RecordBatch.from_arrays([pa.array(nodes[pick]), pa.array(out[pick])], ["node", "links"])


def _span_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of this block that join its components, as few as do."""
    one, two, link = _block_links(table)
    nodes, known = (np.asarray(table.column(c)) for c in ("node", "component"))
    _, root = np.unique(known, return_inverse=True)
    link &= root[one][:, None] != root[two][None, :]
    parent = list(range(len(nodes)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    made = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(link))):
        x, y = top(int(root[one[a]])), top(int(root[two[b]]))
        if x != y:
            parent[x] = y
            made.append((int(one[a]), int(two[b])))
    at = np.array(made, dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["u", "v"])


def _blocks(members: DataFrame, *told: str) -> DataFrame:
    """Cuts each cluster into parts of bounded size; every two parts are a block, which has the rows of both.

    Of a cluster's members the least that one task holds is that of one block, so the largest cluster is work for many tasks.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    members = members.join(members.groupBy("cluster").agg(parts.alias("parts")), "cluster")
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return members.select("cluster", "node", *told, "part", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"))


def _in_blocks(blocks: DataFrame, sets: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    keys = ["cluster", "row", "col"]
    rows = blocks.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    return rows.mapInArrow(_by_block(work), schema)


def _count_links(found: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, links: copies of other classes that a class links to.

    Components are counted in blocks.
    """
    members = found.join(classes.select("node", "n", "copies"), "node").withColumnRenamed("component", "cluster")
    counted = _in_blocks(_blocks(members, "copies"), sets, _count_block, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def groups(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """Of every row: doc_id, _text (a hash of its text), n, node (its class), component, component_id, and n_links if asked for.

    `component` tells components apart even where ids are null or repeated; it and `node` are null for empty sets.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    described = texts.mapInArrow(
        _describe(to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, _text long, node long, n long, common long, times long"
    )
    described = cut_lineage(described)
    rows = described.where(F.col("node").isNotNull()).select("doc_id", "_text", "node", "n")
    # One row stands for the class: of those with its least id, the one with the least text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_text"))
    classes = rows.where("n > 0").groupBy("node").agg(first.alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = cut_lineage(classes.select("node", F.col("first.doc_id").alias("least_id"), F.col("first._text").alias("_text"), "n", "copies"))

    common, times, mean_list = _common(described)
    shared = spark.sparkContext.broadcast((common, times))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= LIGHT_SIZES).groupBy("n").count().collect()}
    total = classes.agg(F.sum("n")).first()[0] or 0
    light = boundary(sizes, mean_list / max(total, 1))
    buckets = 1 << max(LEAST_BUCKETS - 1, total // (4 * BUCKET_KEYS)).bit_length()
    posted = texts.mapInArrow(_post(buckets, light, shared), "bucket long, nodes binary, sizes binary, counts binary, keys binary")
    lists = _pruned(cut_lineage(posted.groupBy("bucket").applyInArrow(_lists, "key long, node long, n long")), light)
    found, sets = _link(lists, light, lambda nodes: _class_sets(texts, nodes.join(classes, "node")))
    per_class = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per_class = per_class.join(per_class.groupBy("component").agg(F.min("least_id").alias("component_id")), "component")
    told = ["node", "component", "component_id"]
    if count_links:
        per_class = per_class.join(_count_links(found, classes, sets), "node", "left")
        per_class = per_class.withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        told.append("n_links")
    filled = rows.where("n > 0").join(per_class.select(*told), "node")
    none = F.lit(None).cast("long")
    empty = rows.where("n = 0").withColumns({"node": none, "component": none, "component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    columns = ["doc_id", "_text", "n", *told]
    return filled.select(*columns).unionAll(empty.select(*columns))


def _class_sets(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """node, shingles: the sets of some classes, each made again from the text that stands for it."""
    wanted = cut_lineage(classes.select(F.col("least_id").alias("_id"), F.col("_text").alias("_first")))
    n = wanted.count()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_first"))
    sets = cut_lineage(texts.join(bounded_broadcast(wanted, n), same, "left_semi").mapInArrow(by_chunk(_sets), "node long, shingles binary"))
    # Only rows that are repeated with their id can be there twice.
    return sets if sets.count() == n else cut_lineage(sets.dropDuplicates(["node"]))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (a set's fingerprint, null if empty) and n_links for every row."""
    found = groups(docs, count_links=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("node").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked, directly or not, to one with a smaller id; one row of each component stays.

    Rows without words all stay.
    """
    found = cut_lineage(groups(docs).where(F.col("component").isNotNull()))
    # Of rows with the least id, those of one text: ids may be repeated or null.
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = found.where(least).groupBy("component").agg(F.min("_text").alias("_kept"))
    stays = found.join(kept, "component").withColumn("_stays", least & (F.col("_text") == F.col("_kept")))
    goes = cut_lineage(stays.where(~F.col("_stays")).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_gone")).distinct())
    # Rows travel as one column, so that their own columns may have any name.
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_text"))
    goes = bounded_broadcast(goes, goes.count())
    left = keyed.join(goes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_gone")), "left_anti")
    repeated = cut_lineage(stays.where("_stays").groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_same")).count().where("count > 1").drop("count"))
    n = repeated.count()
    if n:
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same"))
        repeated = bounded_broadcast(repeated, n)
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_text"]))
    return left.select("_row.*")


def _common(described: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles of very many classes and their counts, sorted, as many as may be broadcast; and the pairs that shared shingles make."""
    counted = cut_lineage(described.where(F.col("common").isNotNull()).groupBy("common").agg(F.sum("times").alias("times")))
    tiers = counted.groupBy(F.floor(F.log2("times")).alias("tier")).agg(F.count("*").alias("n"), F.sum(F.col("times") * (F.col("times") - 1.0)).alias("pairs")).collect()
    least, kept = LEAST_COMMON.bit_length() - 1, 0
    for tier in sorted(tiers, key=lambda t: -t["tier"]):
        kept += tier["n"]
        if tier["tier"] >= least and kept > MOST_COMMON:
            least = tier["tier"] + 1
            break
    table = counted.where(F.col("times") >= 1 << least).toArrow()
    common, times = np.asarray(table.column("common")).view(np.uint64), np.asarray(table.column("times"))
    order = np.argsort(common)
    return common[order], times[order], sum(t["pairs"] for t in tiers if t["tier"] < least)


def _link(lists: DataFrame, light: int, sets_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Components of the classes, and the sets of all classes that were compared; sets_of makes those of some nodes."""
    lists = lists.withColumn("component", F.col("node"))
    links = found = sets = None
    before = math.inf
    for round_ in range(ROUNDS + 1):
        left, members, pairs = _left_over(lists)
        if found is not None and not members:
            break
        last = round_ == ROUNDS or pairs <= PAIRS_PER_KEY * members or pairs > LEFT * before
        before = pairs
        if last:
            long, short = _long_lists(left)
            blocks = cut_lineage(_blocks(long, "component"))
        tried = cut_lineage(_across(short, light) if last else _hub_pairs(left, round_, light))
        nodes = tried.select(F.explode(F.array("u", "v")).alias("node"))
        nodes = (nodes.unionByName(blocks.select("node")) if last else nodes).distinct()
        more = sets_of(nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti"))
        sets = more if sets is None else sets.unionByName(more)
        made = _verify(tried, sets)
        if last:
            made = made.unionByName(_in_blocks(blocks, sets, _span_block, "u long, v long"))
        made = cut_lineage(made)
        links = made if links is None else links.unionByName(made)
        found, lists = _relabel(left, links)
        if last:
            break
    return found, sets

"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch (bins filled in rounds): in round i below t an element goes to the bin its i-th hash
names, in round t+j to bin j, with the value i plus a hashed fraction; a bin keeps its least
value, and the rounds end when every bin is full, at the latest after round 2t-1. Equal
coordinates of two sets are as likely as their Jaccard similarity, with concentration bounds.

Documents with equal sets form one class. Classes that share a band (a bucket) are compared on
their full sets. Buckets are range-partitioned by key and a hash of the member, so a hot bucket
lies in many partitions; each partition cuts its stretch of a bucket into blocks, compares a
block's members with the block's few pivots, and the blocks' pivots meet each other. Where a
bucket is still in several components after these rounds, its members are compared in pairs of
blocks, without those blocks that lie in one and the same component: a pair inside a component
can't change the components, so none has to be formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.text import WordHashes, binary, mix, slices
from talus.operators.components import connected_components
from talus.runtime import stage

#: A pair of similarity 0.8 shares one of 30 bands of 5 coordinates with probability over 0.99999.
BANDS, ROWS = 30, 5
#: Members of a block that meet the block's pivots, and of a block whose members are all compared.
STRIP, BLOCK = 128, 256
#: Rows that a task holds of its stretch of the buckets, and parts a large bucket is dealt into.
HELD, SALTS = 200_000, 16
_COEFFICIENTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the width-word windows; fewer words count as one whole."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < width:
            whole = np.uint64(n)
            for k in range(n):
                whole = mix(np.array([whole ^ (hashes[k] * _COEFFICIENTS[k % 8])], np.uint64))[0]
            return np.array([whole], np.uint64)
        acc = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            acc = mix(acc ^ (hashes[k : n - width + 1 + k] * _COEFFICIENTS[k % 8]))
    return np.unique(acc)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The t coordinates of each non-empty set."""
    counts = np.array([len(s) for s in sets], np.int64)
    values = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = mix(x ^ np.uint64((i + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
            bins = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.uint64(i - t)
            slots = owner * t + (bins.astype(np.int64) if i < t else int(bins))
            np.minimum.at(values, slots, (np.uint64(i) << np.uint64(54)) | (h & np.uint64((1 << 54) - 1)))
            open_ = (values.reshape(-1, t) == np.iinfo(np.uint64).max).any(axis=1)
            if not open_.any():
                break
            live = open_[owner]
            if not live.all():
                x, owner = x[live], owner[live]
    return values.reshape(-1, t)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, which holds the band's number and its coordinates."""
    c = coordinates.reshape(-1, bands, rows)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), c.shape[:2])
        for r in range(rows):
            acc = mix(acc ^ (c[:, :, r] * _COEFFICIENTS[r % 8]))
    return acc


def _sets(texts: list[bytes | None], table: WordHashes, width: int) -> list[np.ndarray]:
    return [shingles(table.of((t or b"").lower().split()), width) for t in texts]


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): s1, s2 fix the set; bands are empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, "text"):
            sets = _sets(binary(batch.column("text")), table, width)
            n = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            keys = band_keys(sketch(full, bands * rows), bands, rows).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *_sums(sets), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _sums(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two sums over each set that fix it."""
    with np.errstate(over="ignore"):
        return [pa.array(np.array([mix(x ^ salt).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)) for salt in (np.uint64(0), _COEFFICIENTS[1])]


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, s1, s2, shingles): the sorted 64-bit shingles of each row as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, "text"):
            sets = _sets(binary(batch.column("text")), table, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_sums(sets), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "s1", "s2", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, s1 long, s2 long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            good = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    return members.drop("component").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def strips(live: DataFrame, pivots: int, percent: int, turn: int) -> DataFrame:
    """Rows of kind 0 are pairs (a, b) to compare, of kind 1 pivots (key, a, n, component) of buckets
    that lie in several strips, of kind 2 the members (key, a, n, component) of buckets of two or more.

    live (key, node, n, component) is dealt by ranges of (key, hash of the node).
    """
    names = ["kind", "key", "a", "b", "n", "component"]
    schema = "kind int, key long, a long, b long, n long, component long"

    def rows(key: np.ndarray, node: np.ndarray, n: np.ndarray, comp: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        cut = sizes > STRIP
        cut[0], cut[-1] = cut[0] or first, cut[-1] or last
        start, size, is_cut = (np.repeat(x, sizes) for x in (starts, sizes, cut))
        at = np.arange(len(key))
        base = start + (at - start) // STRIP * STRIP
        a, b = [], []
        for k in range(pivots):
            p = np.minimum(base + k, len(key) - 1)
            ok = (base + k < at) & (comp[p] != comp) & (np.minimum(n[p], n) * 100 >= np.maximum(n[p], n) * percent)
            a.append(np.minimum(node[p[ok]], node[ok]))
            b.append(np.maximum(node[p[ok]], node[ok]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        up = np.flatnonzero(is_cut & (base == at))
        keep = np.flatnonzero((size > 1) | is_cut) if turn == 0 else np.zeros(0, np.int64)
        none, zero = np.zeros(pairs.shape[1], np.int64), np.zeros(len(up) + len(keep), np.int64)
        own = np.concatenate([up, keep])
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(none), len(up), len(keep)])
        columns = [kinds, np.concatenate([none, key[own]]), np.concatenate([pairs[0], node[own]]), np.concatenate([pairs[1], zero]), np.concatenate([none, n[own]]), np.concatenate([none, comp[own]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, first = [], 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy() for c in ("key", "node", "n", "component")])
            count += batch.num_rows
            if count >= HELD:
                columns = [np.concatenate(c) for c in zip(*held)]
                end = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
                end, whole = (end, True) if end else (count, False)
                yield rows(*(c[:end] for c in columns), first, not whole)
                held, count, first = [[c[end:] for c in columns]], count - end, not whole
        if count:
            yield rows(*(np.concatenate(c) for c in zip(*held)), first, True)

    ordered = live.withColumn("h", F.xxhash64("node", F.lit(turn))).repartitionByRange("key", "h").sortWithinPartitions("key", "h")
    return ordered.select("key", "node", "n", "component").mapInArrow(run, schema)


def pivot_pairs(up: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) among the strips' pivots of each bucket: a STRIP-th of the bucket, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                level = [(m["a"], m["n"], m["component"]) for m in members]
                while len(level) > 1:
                    for x in range(0, len(level), STRIP):
                        p, *others = level[x : x + STRIP]
                        for o in others:
                            if p[2] != o[2] and 100 * min(p[1], o[1]) >= percent * max(p[1], o[1]):
                                a.append(min(p[0], o[0]))
                                b.append(max(p[0], o[0]))
                    level = level[::STRIP]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    grouped = up.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "n", "component"))).alias("members")).where(F.size("members") > 1)
    return grouped.select("members").mapInArrow(run, "a long, b long")


def block_links(live: DataFrame, sets: DataFrame, percent: int, covered: int, torn: DataFrame) -> DataFrame:
    """Links (a, b) that join what the pivots left apart: such buckets are compared whole, block by block.

    Buckets of up to `covered` members have been compared already, but for the torn ones (key),
    which lay in several strips; of buckets with the same members one is compared. Members are sorted by component, cut into blocks of up to BLOCK, and
    each two blocks of a bucket that don't lie in one and the same component are one task's work:
    the exact intersections of all their pairs as products of 0/1 matrices. A task returns, for
    each linked member, the least id of its component there, and no pairs.
    """
    whole = live.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    whole = whole.where("low < high AND m > 2").join(torn.select("key", F.lit(True).alias("torn")).distinct(), "key", "left")
    open_ = whole.where((F.col("m") > covered) | F.col("torn")).groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    salted = open_.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = live.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size, number, part = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            blocks = []
            for key in batch.column("key").to_pylist():
                if key != last or size == BLOCK:
                    last, size, number = key, 0, number + 1
                size += 1
                blocks.append(part << 32 | number)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "node", "component")] + [pa.array(blocks, pa.int64())], ["key", "node", "component", "block"])

    order = ["key", "component", "node"]
    dealt = stage(left.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "key long, node long, component long, block long"), "dup-blocks")
    # one row per block: a BLOCK-th of the members
    ends = dealt.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = ends.alias("x"), ends.alias("y")
    one = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    pairs = x.join(y, "key").where((F.col("x.block") <= F.col("y.block")) & ~one).select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    pairs = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    filled = dealt.select("block", "node").join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        side, ids = group.column("block").to_numpy(), group.column("node").to_numpy()
        each = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        n = np.array([len(x) for x in each], np.int64)
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        owner = np.repeat(np.arange(len(each)), n)
        flat = np.concatenate(each)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        number = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
        same = np.zeros((len(a), len(b)), np.float32)
        at = np.full(len(each), -1)
        rows_a, rows_b = at.copy(), at.copy()
        rows_a[a], rows_b[b] = np.arange(len(a)), np.arange(len(b))
        step = 2048
        cuts = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + step, step))
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            who, what = owner[x:y], number[x:y] - k * step
            sides = []
            for rows, count in ((rows_a, len(a)), (rows_b, len(b))):
                m, ok = np.zeros((count, step), np.float32), rows[who] >= 0
                m[rows[who][ok], what[ok]] = 1
                sides.append(m)
            same += sides[0] @ sides[1].T
        both = np.rint(same).astype(np.int64)
        near = 100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)
        if i == j:
            np.fill_diagonal(near, False)
        least, big = ids.copy(), np.iinfo(np.int64).max
        while near.any():
            new = least.copy()
            new[a] = np.minimum(new[a], np.where(near, least[b][None, :], big).min(axis=1))
            new[b] = np.minimum(new[b], np.where(near, least[a][:, None], big).min(axis=0))
            if (new == least).all():
                break
            least = new
        at = np.flatnonzero(least != ids)
        return pa.Table.from_arrays([pa.array(least[at]), pa.array(ids[at])], ["a", "b"])

    return stage(pairs.join(filled, "block").groupBy("i", "j").applyInArrow(run, "a long, b long"), "dup-block-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, pivots: tuple[int, ...] = (1, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Words are lower-cased A-Z. A row with fewer words than the width has its whole sequence as
    its one shingle; a null text or one without words has an empty set and links with nothing.
    component_id is the smallest doc_id reachable over links; kept says that it is the row's
    own. Rows that repeat a doc_id are joined by that id, whatever their texts, and all links of
    their texts count. A null doc_id is left by itself, with a null component, and kept. Other
    columns are ignored; an empty table gives no rows. Texts are read whole, however long.
    """
    made = stage(sketches(docs, width, bands, rows), "dup-sketches")
    full = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = full.groupBy("doc_id").agg(F.count("*").alias("n"), ((F.min("s1") < F.max("s1")) | (F.min("s2") < F.max("s2"))).alias("several")).where("n > 1")
    repeated = stage(repeated.select("doc_id", "several"), "dup-repeated")
    several = None if repeated.where("several").isEmpty() else repeated.where("several").select("doc_id", "several")

    def named(df: DataFrame) -> DataFrame:
        """With node: the id, or a number of its own (below 0) for each set of an id that has several."""
        if several is None:
            return df.withColumn("node", F.col("doc_id"))
        own = -F.xxhash64("doc_id", "s1", "s2").bitwiseAND(F.lit((1 << 63) - 1)) - 1
        return df.join(several, "doc_id", "left").withColumn("node", F.when(F.col("several"), own).otherwise(F.col("doc_id"))).drop("several")

    full = named(full)
    if not repeated.isEmpty():
        full = stage(full.dropDuplicates(["node"]), "dup-rows")
    # the class of equal sets, named by its smallest node
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("node").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    # the copies of one text may be many: each class is dealt out in SALTS parts
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = full.select("node", "s1", "s2", "n_shingles", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = stage(salted.join(classes, ["s1", "s2", "n_shingles", "salt"]).where("node <> rep").select("node", "rep"), "dup-copies")
    others = full.join(copies, "node", "left_anti")
    keyed = others.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"), F.col("node").alias("component"))

    sets = links = components = members = None
    for turn, count in enumerate(pivots):
        live = keyed if turn == 0 else _labelled(members, components)
        found = stage(strips(live, count, percent, turn), "dup-strips")
        if turn == 0:
            members = found.where("kind = 2").select("key", F.col("a").alias("node"), "n", "component")
            wanted = members.select("node").distinct()
            ids = wanted if several is None else full.select("doc_id", "node").join(wanted, "node", "left_semi").select("doc_id").distinct()
            texts = docs.select("doc_id", "text").join(ids.toDF("doc_id"), "doc_id", "left_semi")
            sets = named(full_sets(texts, width)).where("octet_length(shingles) > 0").select("node", "shingles")
            sets = stage(sets if repeated.isEmpty() else sets.dropDuplicates(["node"]), "dup-sets")
        pairs = found.where("kind = 0").select("a", "b").unionByName(pivot_pairs(found.where("kind = 1"), percent)).distinct()
        new = stage(verified(pairs, sets, percent), "dup-links")
        links = new if links is None else links.unionByName(new)
        components = stage(connected_components(links, "a", "b"), "dup-components")
    live = stage(_labelled(members, components), "dup-live")
    links = links.unionByName(block_links(live, sets, percent, pivots[-1] + 1, found.where("kind = 1")))
    if several is not None:  # the sets of an id meet
        nodes = full.select("doc_id", "node").join(several, "doc_id", "left_semi")
        links = links.unionByName(nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
        links = links.unionByName(copies.select(F.col("rep").alias("a"), F.col("node").alias("b")))
    components = connected_components(links, "a", "b")
    if several is None:
        ends = copies.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
        merged = ends.unionByName(components).withColumnRenamed("node", "doc_id")
    else:
        labelled = stage(_labelled(full.select("doc_id", "node"), components), "dup-labelled")
        least = labelled.groupBy("component").agg(F.min("doc_id").alias("least"))
        merged = labelled.join(least, "component").select("doc_id", F.col("least").alias("component")).distinct()
    return (
        made.select("doc_id", "n_shingles")
        .join(merged, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

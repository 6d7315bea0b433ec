"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

Vectors with the same label and the same components form one class; a class has one code, the
signs of its projections on random hyperplanes. A table's hash is a stretch of the code. What is
dealt out by the tables is the code alone: each bucket is range-partitioned by its key and a
hash of the member, cut into blocks, and each two blocks of a bucket are one task's work, which
marks the members that have a partner of near enough code, counted in the first table whose
stretch they share. Only marked members' vectors are then moved, once for each pair of blocks,
for the exact cosines. No task holds a whole bucket, and no pairs are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.text import mix
from talus.operators.components import connected_components
from talus.runtime import stage

THRESHOLD = 0.93
#: Members of a block of a bucket.
BLOCK = 512
#: Inner products computed at once.
PRODUCTS = 4 << 20
#: Chance with which a pair at the threshold shares a bucket in some table.
RECALL = 0.995
#: Bits of a code at least, and the standard deviations by which a pair's codes may differ more than the threshold's angle has it.
CODE_BITS, DEVIATIONS = 256, 6.0


def table_bits(rows: int) -> int:
    """Bits of a table's hash: buckets hold some hundred vectors, whatever the number of rows."""
    return max(8, math.ceil(math.log2(max(2, rows) / 512)))


def table_count(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - shared))


def code_words(bits: int, tables: int) -> int:
    """64-bit words of a code."""
    return -(-max(CODE_BITS, bits * tables) // 64)


def most_differing(words: int, threshold: float) -> int:
    """The bits in which the codes of a pair at the threshold differ, with some deviations on top."""
    share = math.acos(threshold) / math.pi
    return math.floor(64 * words * share + DEVIATIONS * math.sqrt(64 * words * share * (1 - share)))


def planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, count))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their greatest component to between 0.5 and 1: exact, and no product over- or underflows."""
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    half = -e // 2
    return np.ldexp(np.ldexp(x, half), -e - half)


def stretches(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The tables' hashes of codes (rows of 64-bit words)."""
    flat = np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1, bitorder="little")[:, : bits * tables]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return (flat.reshape(len(code), tables, bits) * weights).sum(axis=2, dtype=np.uint64)


def linkable(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, which vectors can link, where each begins among the components, lengths, components as doubles)."""
    ids, labels, vectors = (batch.column(c) for c in ("vec_id", "label", "embedding"))
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without what lies behind null vectors
    begins = np.concatenate([[0], np.cumsum(sizes)])
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
    bad, some = (np.concatenate([[0], np.cumsum(m)]) for m in (~np.isfinite(x), x != 0))
    within = lambda sums: sums[begins[1:]] - sums[begins[:-1]]
    ok = (sizes > 0) & (within(bad) == 0) & (within(some) > 0)
    for c in (ids, labels):
        ok &= c.is_valid().to_numpy(zero_copy_only=False)
    return ids, labels, ok, begins[:-1], sizes, x


def coded(vectors: DataFrame, words: int, wide: bool) -> DataFrame:
    """(vec_id, label, dim, data, h1, h2, code) of the vectors that can link; data holds float64 if wide, else float32."""
    names = ["vec_id", "label", "dim", "data", "h1", "h2", "code"]
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, ok, begins, sizes, flat = linkable(batch)
            by_dim = {int(d): np.flatnonzero(ok & (sizes == d)) for d in np.unique(sizes[ok])}
            step = max(1, PRODUCTS // (64 * words))
            pieces = [(dim, rows[x : x + step]) for dim, rows in by_dim.items() for x in range(0, len(rows), step)]
            for dim, rows in pieces:
                m = flat[begins[rows][:, None] + np.arange(dim)]
                code = np.packbits(scaled(m) @ planes(dim, 64 * words) >= 0, axis=1, bitorder="little")
                blobs = [r.tobytes() for r in m.astype(kind)]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows)), labels.take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(blobs, pa.binary()),
                    *(pa.array([f(b) - (1 << 63) for b in blobs], pa.int64()) for f in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest)),
                    pa.array([c.tobytes() for c in code], pa.binary()),
                ], names)

    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{'double' if wide else 'float'}>").alias("embedding"))
    return cast.mapInArrow(run, "vec_id long, label long, dim int, data binary, h1 long, h2 long, code binary")


def keyed(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """(key, turn, rep, code): a row per table; the key is fixed by label, dimension, table and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.stack([np.frombuffer(c, np.uint64) for c in batch.column("code").to_pylist()])
            salt = np.array([xxhash.xxh3_64_intdigest(f"{l}/{d}") for l, d in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())], np.uint64)
            key = mix(mix(stretches(code, bits, tables) ^ salt[:, None]) ^ np.arange(1, tables + 1, dtype=np.uint64)).view(np.int64)
            own = batch.select(["rep", "code"])
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(key[:, t]), pa.array(np.full(len(key), t, np.int32)), *own.columns], ["key", "turn", "rep", "code"])

    return reps.select("rep", "label", "dim", "code").mapInArrow(run, "key long, turn int, rep long, code binary")


def blocked(rows: DataFrame) -> DataFrame:
    """With block: the members of a bucket in blocks of up to BLOCK, dealt by ranges of (key, hash of the member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size, number, part = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            blocks = []
            for key in batch.column("key").to_pylist():
                if key != last or size == BLOCK:
                    last, size, number = key, 0, number + 1
                size += 1
                blocks.append(part << 32 | number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*batch.schema.names, "block"])

    ordered = rows.withColumn("h", F.xxhash64("rep")).repartitionByRange("key", "h").sortWithinPartitions("key", "h").drop("h")
    return ordered.mapInArrow(run, "key long, turn int, rep long, code binary, block long")


def near_codes(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of codes differ in up to `most` bits."""
    differing = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        differing += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None, :])
    return differing <= most


def seen_before(x: np.ndarray, y: np.ndarray, turn: int) -> np.ndarray:
    """Which pairs share the hash of an earlier table."""
    seen = np.zeros((len(x), len(y)), bool)
    for t in range(turn):
        seen |= x[:, t][:, None] == y[:, t][None, :]
    return seen


def marked(bits: int, tables: int, most: int):
    """The members (i, j, turn, rep, side) of two blocks that have a partner in the other one."""

    def run(group: pa.Table) -> pa.Table:
        i, j, turn = (group.column(c)[0].as_py() for c in ("i", "j", "turn"))
        block, code = group.column("block").to_numpy(), np.stack([np.frombuffer(c, np.uint64) for c in group.column("code").to_pylist()])
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        hashes = stretches(code, bits, tables)
        near = near_codes(code[a], code[b], most) & ~seen_before(hashes[a], hashes[b], turn)
        if i == j:
            np.fill_diagonal(near, False)
        at = np.union1d(a[near.any(axis=1)], b[near.any(axis=0)])
        return group.take(pa.array(at)).select(["i", "j", "turn", "rep", "block", "code"])

    return run


def compared(bits: int, tables: int, threshold: float, wide: bool):
    """Links between the marked members of two blocks (or within one): (rep, links, least) per linked vector."""
    kind = np.float64 if wide else np.float32

    def run(group: pa.Table) -> pa.Table:
        i, j, turn = (group.column(c)[0].as_py() for c in ("i", "j", "turn"))
        block, ids, size = (group.column(c).to_numpy() for c in ("block", "rep", "size"))
        code = np.stack([np.frombuffer(c, np.uint64) for c in group.column("code").to_pylist()])
        x = scaled(np.stack([np.frombuffer(b, kind) for b in group.column("data").to_pylist()]).astype(np.float64))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        norm = np.sqrt((x * x).sum(axis=1))
        hashes = stretches(code, bits, tables)
        near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold
        near &= ~seen_before(hashes[a], hashes[b], turn)
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(ids), np.int64)
        links[a] += near @ size[b]
        if i != j:
            links[b] += near.T @ size[a]
        least, big = ids.copy(), np.iinfo(np.int64).max
        while near.any():  # the least id of each vector's component within these blocks
            new = least.copy()
            new[a] = np.minimum(new[a], np.where(near, least[b][None, :], big).min(axis=1))
            new[b] = np.minimum(new[b], np.where(near, least[a][:, None], big).min(axis=0))
            if (new == least).all():
                break
            least = new
        at = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(least[at])], ["rep", "links", "least"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is
    at least the threshold; components of any size that a double has count. A null, empty or
    zero vector, or one with null or non-finite components, links with nothing; neither do
    vectors of different length. Rows that repeat a vec_id are joined by it: with the same
    vector they link with each other, and n_links is the greatest of the id's rows. A null
    vec_id links with nothing, has a null component and is kept. Other columns are ignored; an
    empty table gives no rows.
    """
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    bits = table_bits(vectors.count())
    tables = table_count(bits, threshold)
    words = code_words(bits, tables)
    made = stage(coded(vectors, words, wide), "vec-codes")
    # the class of equal vectors is named by its smallest id; an id with several vectors has a number of its own for each
    several = made.groupBy("vec_id").agg(((F.min("h1") < F.max("h1")) | (F.min("label") < F.max("label"))).alias("several")).where("several")
    several = stage(several, "vec-repeated")
    rows = made.select("vec_id", "label", "dim", "h1", "h2")
    repeated = not several.isEmpty()
    own = -F.xxhash64("vec_id", "label", "h1", "h2").bitwiseAND(F.lit((1 << 63) - 1)) - 1
    node = F.when(F.col("several"), own).otherwise(F.col("vec_id")) if repeated else F.col("vec_id")
    named = (lambda df: df.join(several, "vec_id", "left").withColumn("node", node).drop("several")) if repeated else (lambda df: df.withColumn("node", node))
    rows = named(rows)
    classes = rows.groupBy("label", "dim", "h1", "h2").agg(F.min("node").alias("rep"), F.count("*").alias("size"))
    copies = stage(rows.join(classes, ["label", "dim", "h1", "h2"]).select("vec_id", "node", "rep", "size"), "vec-copies")
    sizes = copies.where("node = rep").select("rep", "size").distinct()
    reps = named(made).withColumnRenamed("node", "rep").join(sizes, "rep").dropDuplicates(["rep"])
    reps = stage(reps.select("rep", "label", "dim", "code", "data", "size"), "vec-classes")
    dealt = stage(blocked(keyed(reps, bits, tables)), "vec-blocks")
    # a row per block that has company: a BLOCK-th of the members
    ends = dealt.groupBy("key", "turn", "block").agg(F.count("*").alias("n"))
    x, y = ends.alias("x"), ends.alias("y")
    pairs = x.join(y, "key").where((F.col("x.block") < F.col("y.block")) | ((F.col("x.block") == F.col("y.block")) & (F.col("x.n") > 1)))
    pairs = pairs.select(F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.col("x.turn").alias("turn"))
    pairs = pairs.select("i", "j", "turn", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    close = pairs.join(dealt.select("block", "rep", "code"), "block").groupBy("i", "j").applyInArrow(marked(bits, tables, most_differing(words, threshold)), "i long, j long, turn int, rep long, block long, code binary")
    filled = stage(close, "vec-close").join(reps.select("rep", "data", "size"), "rep")
    found = stage(filled.groupBy("i", "j").applyInArrow(compared(bits, tables, threshold, wide), "rep long, links long, least long"), "vec-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("least").alias("b"))
    if repeated:  # the vectors of an id meet
        ids = copies.join(several, "vec_id", "left_semi")
        edges = edges.unionByName(ids.join(ids.groupBy("vec_id").agg(F.min("rep").alias("a")), "vec_id").select("a", F.col("rep").alias("b")))
    components = connected_components(edges, "a", "b").withColumnRenamed("node", "rep")
    info = copies.join(links, "rep", "left").join(components, "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    if repeated:
        info = stage(info, "vec-info")
        info = info.drop("c").withColumn("g", F.coalesce("component", "rep")).join(info.groupBy(F.col("c").alias("g")).agg(F.min("vec_id").alias("c")), "g")
    info = info.groupBy("vec_id").agg(F.max(F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.min("c").alias("c"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(info, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

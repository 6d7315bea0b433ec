"""A hashed maximum-entropy language model with a class-factored softmax.

p(w | h) = p(class(w) | h) * p(cell(w) | class(w), h) * p(w | cell(w)).  The KEPT most frequent
training tokens and the end are classes of their own; every other token belongs to one of
SUFFIXES classes by its last two characters, so unseen tokens have a class too, and within it to
one of 2^bits cells by its hash. Both softmaxes take features of the tokens before:
  class  hashed n-grams and skips: the class before, with and without the coarse group of the
         one before it, the groups of the second and third token before, and the word before
         itself, hashed to a row of its class and cell
  cell   the cell, and the cell with the coarse group of the token before
A token within a cell has its add-0.1 share of the cell's training tokens, as in the base model.
The number of cells, and with it of word rows, grows with the number of distinct training tokens
(one for each CELL_TYPES of them, up to 2^8 a class, which is what every task holds of the model).

Passes, each over written tables:
  blocks   texts -> blocks of documents: token positions in the block's own vocabulary, and
           that vocabulary's sorted 64-bit hashes with counts
  buckets  the blocks' vocabularies meet by ranges of the hash, as many as hold BUCKET_TYPES
           entries each; exact training counts go back to the blocks
  encode   block by block: base score, share within the cell, and a class and cell per token
  counts   what the features' observed counts are sums of, added up in a tree
  rounds   each round every task adds up the expected counts of its contexts; the driver applies
           the summed gradient to the weights and sends them out again
  score    sparse look-ups of the features' weights for every token, in numpy batches
What a block or a bucket holds doesn't grow with the corpus (the number of either does).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.text import binary, mix, slices
from talus.runtime import drop_path, stage, staged

KEPT, SUFFIXES = 63, 192
CLASSES = 1 + KEPT + SUFFIXES
#: Coarse groups of classes, for the tokens before the last.
GROUPS = 8
#: Rows of the hashed weight table.
FEATURE_ROWS = 1 << 12
#: Bits of the hash that name a cell at most, and distinct tokens per cell.
CELL_BITS, CELL_TYPES = 8, 512
#: Entries of a bucket, about.
BUCKET_TYPES = 1 << 19
#: Distinct tokens of a block from which on it is closed.
BLOCK_TYPES = 50_000
#: Tokens of a block from which on it is closed, however few distinct ones it has.
BLOCK_TOKENS = 1 << 20
ADD = 0.1
END = b" "  # no word has a space
ROUNDS = 24
#: Partial sums that one task adds up, and tasks of a round (its work is bounded by the size of the model).
FAN, TASKS = 32, 3


class _Block(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-8:].decode("utf-8", "ignore")[-2:].encode()) % SUFFIXES


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of kind 0 hold a block's documents, rows of kind 1 its vocabulary in the order of the hashes."""
    names = ["kind", "block", "types", "a", "b", "c", "d", "e"]

    def rows(block: int, docs: list[tuple[int | None, bool, np.ndarray]], vocab: _Block) -> pa.RecordBatch:
        kind = np.dtype("<u2") if len(vocab) <= 1 << 16 else np.dtype("<u4")
        held = np.array([d[1] for d in docs], np.uint8)
        lengths = np.array([len(d[2]) for d in docs], np.int64)
        known = np.array([d[0] is not None for d in docs], np.uint8)
        tokens = np.concatenate([d[2] for d in docs])
        train = np.repeat(held == 0, lengths)
        counts = np.bincount(tokens[train], minlength=len(vocab)).astype("<u4")
        words = list(vocab)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        suffixes = np.fromiter(map(suffix_class, words), np.uint8, len(words))
        ids = np.array([d[0] if d[0] is not None else 0 for d in docs], np.int64)
        # tokens are stored as places in the order of the hashes, so that the buckets' answers line up
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        hashes, suffixes = hashes[order], suffixes[order].tobytes()
        out = [
            (0, block, 0, ids.tobytes() + known.tobytes(), held.tobytes(), lengths.tobytes(), place[tokens].astype(kind).tobytes(), suffixes + hashes.astype("<u4").tobytes()),
            (1, block, len(words), hashes.tobytes(), counts[order].tobytes(), suffixes, b"", b""),
        ]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, vocab, tokens = TaskContext.get().partitionId(), 0, [], _Block(), 0
        for batch in slices(batches, "text"):
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), binary(batch.column("text"))):
                words = (text or b"").lower().split()
                words.append(END)
                held.append((doc, out, np.fromiter(map(vocab.__getitem__, words), np.int64, len(words))))
                tokens += len(words)
                if len(vocab) >= BLOCK_TYPES or tokens >= BLOCK_TOKENS:
                    yield rows(part << 32 | made, held, vocab)
                    made, held, vocab, tokens = made + 1, [], _Block(), 0
        if held:
            yield rows(part << 32 | made, held, vocab)

    return docs.mapInArrow(run, "kind int, block long, types long, a binary, b binary, c binary, d binary, e binary")


def bucket_bits(types: int) -> int:
    """The top bits of the hash that name a bucket, so that a bucket has about BUCKET_TYPES of the blocks' entries."""
    return max(4, math.ceil(math.log2(max(1, types) / BUCKET_TYPES)))


def sliced(made: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, a, b, c): the blocks' vocabularies cut by the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("block", "a", "b", "c"))):
                top = (np.frombuffer(a, np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
                rows = [(block, int(top[x]), a[8 * x : 8 * y], b[4 * x : 4 * y], c[x:y]) for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(top)])]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), [pa.int64(), pa.int32(), *[pa.binary()] * 3])], ["block", "bucket", "a", "b", "c"])

    return made.where("kind = 1").select("block", "a", "b", "c").mapInArrow(run, "block long, bucket int, a binary, b binary, c binary")


COUNTED = "kind int, block long, bucket int, totals binary, hash long, count long, types long"


def count_bucket(group: pa.Table) -> pa.Table:
    """Exact training counts of a bucket's tokens: back to each block (kind 0), the most frequent
    tokens (kind 1) and the sums by suffix class and cell (kind 2)."""
    block, bucket = group.column("block").to_pylist(), group.column("bucket")[0].as_py()
    hashes = [np.frombuffer(x, np.uint64) for x in group.column("a").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in group.column("b").to_pylist()]
    suffixes = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("c").to_pylist()])
    distinct, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    ends = np.cumsum([0] + [len(h) for h in hashes])
    width = "<u4" if not len(total) or total.max() < 1 << 32 else "<u8"
    answers = [width[2].encode() + total[back[x:y]].astype(width).tobytes() for x, y in zip(ends[:-1], ends[1:])]
    top = np.lexsort((distinct, -total))[: KEPT + 1]
    top = top[total[top] > 0]
    cell = suffixes[first].astype(np.int64) << CELL_BITS | (distinct & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
    sums, types = np.bincount(cell, total, SUFFIXES << CELL_BITS).astype(np.int64), np.bincount(cell[total > 0], minlength=SUFFIXES << CELL_BITS)
    live = np.flatnonzero(types)
    none = lambda n: np.zeros(n, np.int64)
    n0, n1, n2 = len(answers), len(top), len(live)
    columns = [
        np.repeat(np.array([0, 1, 2], np.int32), [n0, n1, n2]), np.concatenate([np.array(block, np.int64), none(n1 + n2)]),
        np.concatenate([np.full(n0, bucket, np.int64), cell[top], live]).astype(np.int32), pa.array(answers + [b""] * (n1 + n2), pa.binary()),
        np.concatenate([none(n0), distinct[top].view(np.int64), none(n2)]), np.concatenate([none(n0), total[top], sums[live]]), np.concatenate([none(n0), none(n1) + 1, types[live]]),
    ]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["kind", "block", "bucket", "totals", "hash", "count", "types"])


@dataclass
class Vocabulary:
    """What the classes and cells need: at most KEPT tokens and a sum for each suffix class and cell."""

    tokens: int
    types: int
    bits: int  # of the hash that name a cell
    kept: list[tuple[int, int, int]]  # low half of the hash, suffix class, count
    ends: int
    cell_tokens: np.ndarray  # (SUFFIXES, 2^bits)
    cell_types: np.ndarray

    @property
    def cells(self) -> int:
        return 1 << self.bits

    @property
    def rows(self) -> int:
        """Rows of the word before: one for each kept token and the end, one for each cell."""
        return 1 + KEPT + SUFFIXES * self.cells


def vocabulary(counted: DataFrame) -> Vocabulary:
    end = np.uint64(xxhash.xxh3_64_intdigest(END)).view(np.int64)
    top = counted.where(F.col("kind") == 1).where(F.col("hash") != int(end))
    top = top.orderBy(F.desc("count"), "hash").limit(KEPT).collect()
    last = counted.where((F.col("kind") == 1) & (F.col("hash") == int(end))).collect()
    sums = counted.where(F.col("kind") == 2).groupBy("bucket").agg(F.sum("count").alias("n"), F.sum("types").alias("v")).toArrow()  # SUFFIXES << CELL_BITS rows at most
    n, v = np.zeros(SUFFIXES << CELL_BITS, np.int64), np.zeros(SUFFIXES << CELL_BITS, np.int64)
    at = sums.column("bucket").to_numpy()
    n[at], v[at] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
    tokens, types = int(n.sum()), int(v.sum())
    for r in [*top, *last]:  # tokens with a class of their own leave their cell
        n[r["bucket"]] -= r["count"]
        v[r["bucket"]] -= 1
    kept = [(r["hash"] & 0xFFFFFFFF, r["bucket"] >> CELL_BITS, r["count"]) for r in top]
    bits = min(CELL_BITS, max(0, math.floor(math.log2(max(1, types) / (SUFFIXES * CELL_TYPES)))))
    fold = lambda x: x.reshape(SUFFIXES, -1, 1 << bits).sum(axis=1)  # noqa: E731  (a cell is named by the low bits)
    return Vocabulary(tokens, types, bits, kept, sum(r["count"] for r in last), fold(n), fold(v))


def encode(made: DataFrame, counted: DataFrame, voc: Vocabulary) -> DataFrame:
    """A row per document: base score, share within the cells, and the classes and cells of its tokens."""
    end = (int(xxhash.xxh3_64_intdigest(END)) & 0xFFFFFFFF, suffix_class(END), voc.ends)
    # a token is known by half its hash, its suffix class and its exact count together
    own = [(0, *end), *((1 + k, *x) for k, x in enumerate(voc.kept))]
    base_rest = np.log10(voc.tokens + ADD * (voc.types + 1)) if voc.tokens else np.log10(ADD)
    cell_rest = np.log10(voc.cell_tokens + ADD * (voc.cell_types + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes", "cells"]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        d = {c: docs.column(c)[0].as_py() for c in "abcde"}
        lengths, held = np.frombuffer(d["c"], np.int64), np.frombuffer(d["b"], np.uint8)
        ids, known = np.frombuffer(d["a"][: 8 * len(held)], np.int64), np.frombuffer(d["a"][8 * len(held) :], np.uint8)
        types = len(d["e"]) // 5
        suffix, marks = np.frombuffer(d["e"], np.uint8, types).astype(np.int64), np.frombuffer(d["e"], "<u4", types, types)
        tokens = np.frombuffer(d["d"], "<u2" if types <= 1 << 16 else "<u4")
        order = np.argsort(answers.column("part").to_numpy(), kind="stable")
        totals = answers.column("totals").to_pylist()
        c = np.concatenate([np.frombuffer(totals[i], f"<u{totals[i][:1].decode()}", offset=1).astype(np.int64) for i in order])
        kind, cell = 1 + KEPT + suffix, (marks & np.uint32(voc.cells - 1)).astype(np.int64)
        for number, mark, of, count in own:
            kind[(marks == mark) & (suffix == of) & (c == count)] = number
        cell[kind <= KEPT] = 0
        base = np.log10(c + ADD) - base_rest
        within = np.where(kind > KEPT, np.log10(c + ADD) - cell_rest[suffix, cell], 0.0)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ends = starts + lengths
        sums = [np.add.reduceat(x[tokens], starts) for x in ((c > 0).astype(np.int64), base, within)]
        per_token = [x.astype(np.uint8)[tokens] for x in (kind, cell)]
        out = [
            pa.array([int(i) if k else None for i, k in zip(ids, known)], pa.int64()), pa.array(held == 1), pa.array(lengths), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]),
            *(pa.array([t[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary()) for t in per_token),
        ]
        return pa.Table.from_arrays(out, names)

    answers = counted.where("kind = 0").select(F.col("block").alias("owner"), F.col("bucket").alias("part"), "totals")
    left = made.where("kind = 0").select("block", "a", "b", "c", "d", "e")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary, cells binary"
    return left.groupBy("block").cogroup(answers.groupBy("owner")).applyInArrow(run, schema)


def before(x: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The value k tokens before each token of the concatenated documents; 0 (an end) before a document."""
    out = np.zeros(len(x), np.int64)
    out[k:] = x[:-k] if len(x) > k else 0
    lens = np.diff(np.append(starts, len(x)))
    for j in range(k):
        out[starts[lens > j] + j] = 0
    return out


def word_rows(classes: np.ndarray, cells: np.ndarray, bits: int) -> np.ndarray:
    """The row of each token as the word before another."""
    return np.where(classes <= KEPT, classes, 1 + KEPT + ((classes - 1 - KEPT) << bits | cells))


def contexts(classes: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The context code of each token of the concatenated documents: last class, two coarse groups."""
    c1, c2, c3 = (before(classes, starts, k) for k in (1, 2, 3))
    return (c1 * GROUPS + groups[c2]) * GROUPS + groups[c3]


PAIRS = GROUPS * GROUPS
CONTEXTS = CLASSES * PAIRS
#: Cells of the counts that are written as one row.
_CHUNK = 1 << 16


def features(codes: np.ndarray) -> np.ndarray:
    """Hashed weight rows of contexts: bigram, trigram (coarse), skip over one, skip over two and order."""
    c1, g2, g3 = codes // (GROUPS * GROUPS), codes // GROUPS % GROUPS, codes % GROUPS
    keys = [c1 * 4, (c1 * GROUPS + g2) * 4 + 1, g3 * 4 + 2, (g2 * GROUPS + g3) * 4 + 3]
    return np.stack([(mix(k.astype(np.uint64)) % np.uint64(FEATURE_ROWS)).astype(np.int64) for k in keys])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, classes, cells, starts of the documents)"""
    for batch in slices(batches, "classes", 1 << 20):
        blobs = batch.column("classes").to_pylist()
        starts = np.concatenate([[0], np.cumsum(np.array([len(b) for b in blobs], np.int64))[:-1]])
        cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8) if "cells" in batch.schema.names else None
        yield batch, np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64), cells.astype(np.int64) if cells is not None else None, starts


def bigrams(train: DataFrame) -> np.ndarray:
    """Counts of class pairs: CLASSES squared numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for _, classes, _, starts in _batches(batches):
            total += np.bincount(before(classes, starts, 1) * CLASSES + classes, minlength=CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    summed = train.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


def coarse_groups(pairs: np.ndarray, turns: int = 12) -> np.ndarray:
    """Classes in GROUPS groups of like followers and predecessors (k-means with fixed starts)."""
    x = np.hstack([np.sqrt((m + 0.01) / (m + 0.01).sum(axis=1, keepdims=True)) for m in (pairs, pairs.T)])
    weight = pairs.sum(axis=1) + 1e-9
    centres = [int(np.argmax(weight))]
    while len(centres) < GROUPS:
        far = np.min([((x - x[c]) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(int(np.argmax(far * np.sqrt(weight))))
    mid = x[centres].copy()
    group = np.zeros(len(x), np.int64)
    for _ in range(turns):
        group = np.argmin(((x[:, None, :] - mid[None]) ** 2).sum(axis=2), axis=1)
        for g in range(GROUPS):
            if (group == g).any():
                mid[g] = np.average(x[group == g], axis=0, weights=weight[group == g])
    return group


@dataclass
class Layout:
    """Where the counts lie in one row of cells: classes by context, classes and pairs of groups by word row, cells by group and class."""

    rows: int
    bits: int

    def __post_init__(self):
        up = lambda n: -(-n // _CHUNK) * _CHUNK  # noqa: E731  (each part starts a chunk of its own)
        self.by_row = up(CONTEXTS * CLASSES)
        self.by_pair = self.by_row + up(self.rows * CLASSES)
        self.by_cell = self.by_pair + up(self.rows * PAIRS)
        self.size = self.by_cell + up((GROUPS * SUFFIXES) << self.bits)

    def cells_of(self, classes: np.ndarray, cells: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        codes = contexts(classes, starts, groups)
        row = before(word_rows(classes, cells, self.bits), starts, 1)
        wide = np.flatnonzero(classes > KEPT)
        inner = ((groups[codes[wide] // PAIRS] * SUFFIXES + classes[wide] - 1 - KEPT) << self.bits) | cells[wide]
        return np.concatenate([codes * CLASSES + classes, self.by_row + row * CLASSES + classes, self.by_pair + row * PAIRS + codes % PAIRS, self.by_cell + inner])


def _added(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(_CHUNK, np.int64)
    for cells, n in zip(group.column("cells").to_pylist(), group.column("n").to_pylist()):
        total[np.frombuffer(cells, "<u2")] += np.frombuffer(n, "<u8").astype(np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def feature_counts(train: DataFrame, groups: np.ndarray, layout: Layout) -> DataFrame:
    """(chunk, counts): the counts of the layout's cells, _CHUNK in a row.

    The tasks' sums are added FAN at a time, level by level, so no task gets all of them.
    """
    schema = "part int, chunk int, cells binary, n binary"
    chunks = layout.size // _CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(layout.size, np.int64)
        for _, classes, cells, starts in _batches(batches):
            total += np.bincount(layout.cells_of(classes, cells, starts, groups), minlength=layout.size)
        part = TaskContext.get().partitionId()
        for k in range(chunks):
            n = total[k * _CHUNK : (k + 1) * _CHUNK]
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([n[at].astype("<u8").tobytes()], pa.binary())], ["part", "chunk", "cells", "n"])

    def merge(group: pa.Table) -> pa.Table:
        at, n = _added(group)
        return pa.Table.from_arrays([group.column("part").slice(0, 1), group.column("chunk").slice(0, 1), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([n.astype("<u8").tobytes()], pa.binary())], ["part", "chunk", "cells", "n"])

    def last(group: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.float64)
        at, n = _added(group)
        total[at] = n
        return pa.Table.from_arrays([group.column("chunk").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    sums = stage(train.select("classes", "cells").mapInArrow(run, schema), "lm-sums")
    parts = (sums.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    while parts > FAN:
        sums = stage(sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("chunk", "part").applyInArrow(merge, schema), "lm-sums")
        parts = -(-parts // FAN)
    return sums.groupBy("chunk").applyInArrow(last, "chunk int, counts binary")


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))


@dataclass
class Model:
    """The weights: by hashed feature and class, by word row and class, by group and cell."""

    groups: np.ndarray
    bits: int
    prior: np.ndarray  # (CLASSES,)
    hashed: np.ndarray  # (FEATURE_ROWS, CLASSES)
    words: np.ndarray  # (rows, CLASSES)
    cells: np.ndarray  # (1 + GROUPS, SUFFIXES, 2^bits): of the cell, and of the cell with a group before it

    def by_context(self, codes: np.ndarray) -> np.ndarray:
        """What the features but the word row add up to, for each class."""
        out = np.empty((len(codes), CLASSES), np.float32)
        for x in range(0, len(codes), 1024):
            out[x : x + 1024] = self.prior + self.hashed[features(codes[x : x + 1024])].sum(axis=0)
        return out

    def cell_logs(self) -> np.ndarray:
        """Natural log p(cell | class, group before): (GROUPS, SUFFIXES, 2^bits)."""
        return _log_softmax(self.cells[0] + self.cells[1:])


def row_class(rows: np.ndarray, bits: int) -> np.ndarray:
    return np.where(rows <= KEPT, rows, 1 + KEPT + ((rows - 1 - KEPT) >> bits))


def word_chunk(chunk: int, layout: Layout) -> range:
    """The word rows whose pairs of groups lie in a chunk."""
    first = (chunk * _CHUNK - layout.by_pair) // PAIRS
    return range(first, min(layout.rows, first + _CHUNK // PAIRS))


def train_rounds(counts: DataFrame, layout: Layout, groups: np.ndarray, prior: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after `rounds` synchronous updates over all contexts.

    A context is a word row with a pair of groups; its class distribution is a softmax of the
    weights of its features. What a round needs of the corpus is how often each context occurs;
    what was observed is summed up once. A weight's step is its gradient over the mean of
    observed and expected counts (a diagonal preconditioner), divided among the features.
    """
    spark = counts.sparkSession
    seen = [np.zeros((FEATURE_ROWS, CLASSES)), np.zeros((layout.rows, CLASSES), np.float32), np.zeros((GROUPS, SUFFIXES, 1 << layout.bits))]
    for r in counts.where(~F.col("chunk").between(layout.by_pair // _CHUNK, layout.by_cell // _CHUNK - 1)).toLocalIterator():
        n, at = np.frombuffer(r["counts"], np.float64), r["chunk"] * _CHUNK
        if at < layout.by_row:
            by_code = n.reshape(-1, CLASSES)
            codes = np.flatnonzero(by_code.sum(axis=1)) if at < CONTEXTS * CLASSES else []
            for rows in features(at // CLASSES + np.array(codes, np.int64)):
                np.add.at(seen[0], rows, by_code[codes])
            continue
        target, start = (seen[1], layout.by_row) if at < layout.by_pair else (seen[2], layout.by_cell)
        flat = target.reshape(-1)
        part = flat[at - start : at - start + _CHUNK]
        part[:] = n[: len(part)]
    model = Model(groups, layout.bits, prior, np.zeros((FEATURE_ROWS, CLASSES), np.float32), np.zeros((layout.rows, CLASSES), np.float32), np.zeros((1 + GROUPS, SUFFIXES, 1 << layout.bits), np.float32))
    pairs = stage(counts.where(F.col("chunk").between(layout.by_pair // _CHUNK, layout.by_cell // _CHUNK - 1)).repartition(TASKS), "lm-pairs")
    of_row = row_class(np.arange(layout.rows), layout.bits)

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, by_code = shared.value, {}
            for batch in batches:
                for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                    n, rows = np.frombuffer(blob, np.float64).astype(np.float32).reshape(-1, PAIRS), word_chunk(chunk, layout)
                    each = np.zeros((len(rows), CLASSES), np.float32)
                    for k, row in enumerate(rows):
                        if not n[k].any():
                            continue
                        c = int(of_row[row])
                        if c not in by_code:
                            by_code[c] = [model.by_context(c * PAIRS + np.arange(PAIRS)), np.zeros((PAIRS, CLASSES))]
                        p = by_code[c][0] + model.words[row]
                        np.exp(p - p.max(axis=1, keepdims=True), out=p)
                        p *= (n[k] / p.sum(axis=1))[:, None]
                        by_code[c][1] += p
                        each[k] = p.sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([rows.start], pa.int32()), pa.array([each.tobytes()], pa.binary())], ["kind", "row", "expected"])
            expected = np.zeros(model.hashed.shape)
            for c, (_, p) in by_code.items():
                for rows in features(c * PAIRS + np.arange(PAIRS)):
                    np.add.at(expected, rows, p)
            at = np.flatnonzero(expected.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array([expected[i].astype(np.float32).tobytes() for i in at], pa.binary())], ["kind", "row", "expected"])

        step = lambda seen, expected: (seen - expected) / (0.5 * (seen + expected) + 2.0)
        expected = np.zeros(model.hashed.shape)
        # the size of the weights, and TASKS times that of the hashed ones; word rows come by chunks and are updated in place
        found = pairs.mapInArrow(run, "kind int, row int, expected binary").toArrow()
        for kind, row, blob in zip(*(found.column(c) for c in ("kind", "row", "expected"))):
            kind, row, each = kind.as_py(), row.as_py(), np.frombuffer(blob.as_buffer(), np.float32)
            if kind == 0:
                expected[row] += each
                continue
            each = each.reshape(-1, CLASSES)
            own = slice(row, row + len(each))
            model.words[own] += 0.4 * step(seen[1][own], each) - 0.0005 * model.words[own]
        del found
        model.hashed += (0.4 * step(seen[0], expected) - 0.0005 * model.hashed).astype(np.float32)
        # the cells' counts by group and class are few enough for one place
        inner = np.exp(model.cell_logs()) * seen[2].sum(axis=2, keepdims=True)
        model.cells += (0.5 * np.concatenate([step(seen[2].sum(axis=0), inner.sum(axis=0))[None], step(seen[2], inner)]) - 0.0005 * model.cells).astype(np.float32)
        shared.destroy()
    return model


def normalisers(counts: DataFrame, layout: Layout, model: Model) -> np.ndarray:
    """The log of the sum over the classes, for every word row and pair of groups."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    of_row = row_class(np.arange(layout.rows), layout.bits)
    chunks = counts.sparkSession.range(layout.by_pair // _CHUNK, layout.by_cell // _CHUNK, 1, (layout.by_cell - layout.by_pair) // _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                rows = word_chunk(chunk, layout)
                logs, last, by_code = np.zeros((len(rows), PAIRS), np.float32), None, None
                for k, row in enumerate(rows):
                    if of_row[row] != last:
                        last = of_row[row]
                        by_code = model.by_context(last * PAIRS + np.arange(PAIRS))
                    x = by_code + model.words[row]
                    top = x.max(axis=1)
                    logs[k] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([rows.start]), pa.array([logs.tobytes()], pa.binary())], ["first", "logs"])

    out = np.zeros((layout.rows, PAIRS), np.float32)
    found = chunks.mapInArrow(run, "first long, logs binary").toArrow()
    for first, logs in zip(found.column("first").to_pylist(), found.column("logs")):
        x = np.frombuffer(logs.as_buffer(), np.float32).reshape(-1, PAIRS)
        out[first : first + len(x)] = x
    shared.destroy()
    return out


def token_logs(model: Model, logs: np.ndarray, by_code: np.ndarray, inner: np.ndarray, classes: np.ndarray, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 p(class, cell | the tokens before) of each token; by_code is by_context of all codes, inner cell_logs."""
    codes = contexts(classes, starts, model.groups)
    row = before(word_rows(classes, cells, model.bits), starts, 1)
    out = by_code[codes, classes].astype(np.float64) + model.words[row, classes] - logs[row, codes % PAIRS]
    wide = classes > KEPT
    out[wide] += inner[model.groups[codes[wide] // PAIRS], classes[wide] - 1 - KEPT, cells[wide]]
    return out / np.log(10)


def fit(encoded: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> tuple[Model, np.ndarray]:
    """The model of the encoded rows that aren't held out, with its normalisers."""
    train = encoded.where("NOT held_out")
    pairs = bigrams(train)
    groups = coarse_groups(pairs)
    prior = np.log((pairs.sum(axis=0) + ADD) / (pairs.sum() + ADD * CLASSES)).astype(np.float32)
    layout = Layout(voc.rows, voc.bits)
    counts = stage(feature_counts(train, groups, layout), "lm-counts")
    model = train_rounds(counts, layout, groups, prior, rounds)
    return model, normalisers(counts, layout, model)


def encoded_documents(docs: DataFrame, held_out) -> tuple[DataFrame, Vocabulary]:
    spark = docs.sparkSession
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    made, made_path = staged(blocks(flagged), "lm-blocks")
    bits = bucket_bits(made.agg(F.sum("types").alias("n")).first()["n"] or 0)
    counted, counted_path = staged(sliced(made, bits).repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(count_bucket, COUNTED), "lm-buckets")
    voc = vocabulary(counted)
    encoded = stage(encode(made, counted, voc), "lm-encoded")
    drop_path(spark, made_path)
    drop_path(spark, counted_path)
    return encoded, voc


def score(docs: DataFrame, held_out, rounds: int = ROUNDS) -> DataFrame:
    """Score every row of docs (doc_id, text) by a model of the rows for which held_out is false.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Words are
    lower-cased A-Z; each text, a null or empty one too, ends with one end token. Texts are read
    whole, however long. Repeated rows are scored, and learned from, one by one. Rows whose
    held_out is null are learned from. With no training row every token is unknown. A null
    doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    encoded, voc = encoded_documents(docs, held_out)
    model, logs = fit(encoded, voc, rounds)
    table = docs.sparkSession.sparkContext.broadcast((model, logs, model.by_context(np.arange(CONTEXTS)), model.cell_logs().astype(np.float32)))
    n = voc.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, classes, cells, starts in _batches(batches):
            each = token_logs(*table.value, classes, cells, starts)
            total = np.add.reduceat(each, starts) + batch.column("within").to_numpy()
            keep = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*keep[:4], pa.array(np.full(len(starts), n, np.int64)), keep[4], pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

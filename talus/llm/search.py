"""Ranked lexical search by hashed max-sketches.

Terms are the runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document's
score for an item sums, over the item's distinct terms, w * ((10^9 tf) div (1000 tf + 20 m)).

Sketch: a document's impacts grow with tf alone, so its sketch holds the largest tf of the terms
that fall into a cell; a term falls into PROBES cells of a table of 8 to 16 cells a distinct
term. The least of a term's cells is never below its tf, so a look-up gives an upper bound, and
the items of a block are looked up together.

Search, for each block of items: (1) the documents with the K highest bounds of each item are
scored exactly, and the K-th best exact score is a floor under the item's result; (2) the
sketches are read again, and documents whose bound reaches the floor are scored exactly in
descending order of bounds until the bound falls below the K-th best score of the task; (3) the
tasks' K best are ranked. No document is left out that could be ranked, whatever the number of
candidates; what is broadcast is a block of items and K row numbers for each.

Null and empty texts have no terms and are never found; a document's row counts once, so rows
that repeat an id are ranked one by one; rows that repeat an item's id are one item with all
their terms; equal scores go by ascending doc_id, null last; fewer than K documents with a
score above 0 are all returned; an empty table of documents or items gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.text import WordHashes, binary, slices
from talus.runtime import stage

#: Results for an item, items of a block, cells a term falls into, least cells for each distinct term.
K, BLOCK_ITEMS, PROBES, CELLS = 50, 2000, 4, 8
#: Documents whose bounds are held at once.
HELD = 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: ASCII letters and digits stay, in lower case; other ASCII becomes a space.
_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
OUT = "item int, item_id long, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each hash in a table of 2^bits, one row for each probe."""
    with np.errstate(over="ignore"):
        return ((hashes[None, :] * _ODD[:PROBES, None]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(words: list[bytes], table: WordHashes) -> bytes:
    """The cells of a document: largest tf (255 stands for all above 254) of the terms in a cell."""
    counts = Counter(words)
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255).astype(np.uint8)
    order = np.argsort(tf, kind="stable")
    bits = max(6, (CELLS * len(counts) - 1).bit_length())
    cells = np.zeros(1 << bits, np.uint8)
    # ascending by tf: the last that is written into a cell is the largest
    cells[_places(table.of(list(counts))[order], bits).T.ravel()] = np.repeat(tf[order], PROBES)
    return cells.tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, cells, text) for the documents with a term; n counts terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, "text"):
            words = [terms(t) for t in binary(batch.column("text"))]
            keep = pa.array([bool(w) for w in words])
            n = pa.array([len(w) for w in words if w], pa.int64())
            cells = pa.array([sketch(w, table) for w in words if w], pa.binary())
            row, doc_id, text = (batch.column(c).filter(keep) for c in ("row", "doc_id", "text"))
            yield pa.RecordBatch.from_arrays([row, doc_id, n, cells, text], ["row", "doc_id", "n", "cells", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, cells binary, text string")


class Block:
    """A block of items: their terms, weights, and which items hold a term."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.ids = [i for i, _ in items]
        held = [set().union(*map(terms, (t.encode() for t in texts))) for _, texts in items]
        self.vocabulary = sorted(set().union(*held))
        self.index = {t: k for k, t in enumerate(self.vocabulary)}
        owners: list[list[int]] = [[] for _ in self.vocabulary]
        for i, found in enumerate(held):
            for t in found:
                owners[self.index[t]].append(i)
        self.degree = np.array([len(o) for o in owners], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.degree)]).astype(np.int64)
        self.owners = np.array([i for o in owners for i in o], np.int64)
        self.hashes = WordHashes().of(self.vocabulary)
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.n_docs = self.n_terms = 0
        self.places: dict[int, np.ndarray] = {}

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.vocabulary))], np.int64)

    def sums(self, at: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Each item's sum over the terms `at` with these tf; 0 tf is left out, -1 is above all others."""
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        value = np.where(tf < 0, 10**6, (10**9 * tf) // (1000 * np.maximum(tf, 1) + 20 * m)) * self.weight[at]
        degree = self.degree[at]
        ends = np.cumsum(degree)
        if not len(ends):
            return np.zeros(len(self.ids))
        slots = np.arange(ends[-1]) + np.repeat(self.start[at] - (ends - degree), degree)
        # whole numbers far below 2^53: exact in doubles
        return np.bincount(self.owners[slots], np.repeat(value, degree), len(self.ids))

    def bounds(self, cells: bytes, n: int) -> np.ndarray:
        """Upper bounds of the items' scores, from the sketch alone."""
        table = np.frombuffer(cells, np.uint8)
        bits = len(table).bit_length() - 1
        if bits not in self.places:
            self.places[bits] = _places(self.hashes, bits)
        found = table[self.places[bits]].min(axis=0)
        at = np.flatnonzero(found)
        tf = found[at].astype(np.int64)
        return self.sums(at, np.where(tf == 255, -1, tf), n)

    def exact(self, text: bytes, n: int) -> np.ndarray:
        """The items' scores."""
        counts = Counter(filter(self.index.__contains__, terms(text)))
        at = np.fromiter((self.index[t] for t in counts), np.int64, len(counts))
        return self.sums(at, np.fromiter(counts.values(), np.int64, len(counts)), n)


def _document_counts(known: DataFrame, block: Block) -> dict[int, int]:
    """How many documents hold each term of the block."""
    index = block.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            for text in binary(batch.column("text")):
                df.update(filter(index.__contains__, set(terms(text))))
        yield pa.RecordBatch.from_arrays([pa.array([index[t] for t in df], pa.int32()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    return {r.term: r.n for r in known.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _highest(values: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each column, with their labels."""
    if len(values) <= k:
        return values, labels
    top = np.argpartition(-values, k - 1, axis=0)[:k]
    return np.take_along_axis(values, top, 0), np.take_along_axis(labels, top, 0)


def _floors(known: DataFrame, block: Block, k: int) -> np.ndarray:
    """Under each item's result: the k-th best exact score among the documents with the highest bounds."""
    n_items = len(block.ids)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = np.zeros((0, n_items)), np.zeros((0, n_items), np.int64)
        for batch in batches:
            cells, n, row = batch.column("cells").to_pylist(), batch.column("n").to_pylist(), batch.column("row").to_numpy()
            for start in range(0, len(n), HELD):
                part = [block.bounds(c, x) for c, x in zip(cells[start : start + HELD], n[start : start + HELD])]
                labels = np.repeat(row[start : start + HELD, None], n_items, axis=1)
                best, rows = _highest(np.vstack([best, part]), np.vstack([rows, labels]), k)
        at, item = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[at, item]), pa.array(rows[at, item])], ["item", "bound", "row"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, n_items))
        for batch in batches:
            for text, n in zip(binary(batch.column("text")), batch.column("n").to_pylist()):
                best = np.vstack([best, block.exact(text, n)])
                if len(best) >= 2 * k + HELD:
                    best = _highest(best, best, k)[0]
        best = _highest(best, best, k)[0]
        at, item = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[at, item].astype(np.int64))], ["item", "score"])

    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "row"))
    first = known.select("row", "n", "cells").mapInArrow(bound, "item int, bound double, row long").withColumn("rank", order).where(F.col("rank") <= k).select("row").distinct()
    scored = known.select("row", "n", "text").join(F.broadcast(first), "row", "left_semi").select("n", "text").mapInArrow(score, "item int, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    floors = np.ones(n_items)
    for r in scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("rank") == k)).collect():
        floors[r.item] = r.score
    return floors


def _candidates(known: DataFrame, block: Block, floors: np.ndarray, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's k best, scored in descending order of bounds."""
    n_items, ids = len(block.ids), block.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(n_items)]  # heaps of (score, whether there is an id, -id)
        least = floors.copy()
        for batch in batches:
            cells, n, doc_id = (batch.column(c).to_pylist() for c in ("cells", "n", "doc_id"))
            text = batch.column("text")
            for start in range(0, len(n), HELD):
                bounds = np.array([block.bounds(c, x) for c, x in zip(cells[start : start + HELD], n[start : start + HELD])])
                exact: dict[int, np.ndarray] = {}
                for item in np.flatnonzero((bounds >= least).any(axis=0)):
                    column = bounds[:, item]
                    for d in np.argsort(-column, kind="stable"):
                        if column[d] < least[item]:
                            break
                        if d not in exact:
                            exact[d] = block.exact(text[start + int(d)].as_py().encode(), n[start + d])
                        value, i = int(exact[d][item]), doc_id[start + d]
                        if value < least[item]:
                            continue
                        heap = best[item]
                        heapq.heappush(heap, (value, i is not None, -i if i is not None else 0))
                        if len(heap) > k:
                            heapq.heappop(heap)
                        if len(heap) == k:
                            least[item] = max(least[item], heap[0][0])
        rows = [(item, ids[item], -i if given else None, value) for item, heap in enumerate(best) for value, given, i in heap]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])

    return known.select("doc_id", "n", "cells", "text").mapInArrow(run, OUT)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    known = stage(sketches(docs), "search-sketches")
    total = known.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    asked = stage(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct(), "search-items")
    blocks = max(1, math.ceil(asked.select("item_id").distinct().count() / block_items))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks if total.docs else 0):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).groupBy("item_id").agg(F.collect_list("text").alias("texts"))
        block = Block([(r.item_id, r.texts) for r in mine.collect()])
        if not block.vocabulary:
            continue
        block.weigh(_document_counts(known, block), total.docs, total.terms)
        scored = _candidates(known, block, _floors(known, block, k), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return found

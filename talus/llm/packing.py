"""Best-fit packing of documents into sequences by whole runs of equal lengths.

Lengths and gaps are whole numbers up to the capacity, so the documents of one length are one
run and the sequences of one gap are one run. Documents are ranked within their length by the
executors, and placed by rank there. What lies between is a plan over runs, made on the driver:
it takes the longest unplaced run, finds the successor of its length among the gaps (the
smallest gap that holds it), gives the first documents of the run the first sequences of that
gap, moves these sequences to the run of their new gap, and repeats until nothing is unplaced.
The runs are bounded by the capacity and not by the number of documents. The README says why
the sweeps aren't dealt out over range partitions, with figures.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.text import binary, crc32_ids, slices
from talus.llm.tokens import encoder
from talus.runtime import stage

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cuts(total: int, capacity: int) -> list[int]:
    """The starts of a document's pieces: capacity each, the first may be shorter."""
    if total <= capacity:
        return [0]
    rest = total % capacity
    return ([0] if rest else []) + list(range(rest, total, capacity))


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit rounds over (length -> number of pieces).

    Gives (length, first rank, first sequence, offset) rows: the pieces of that length from
    that rank on, up to the length's next row, lie in consecutive sequences at that offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    known: list[int] = []
    plan: list[tuple[int, int, int, int]] = []
    sequences = 0

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                bisect.insort(known, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(known, length)
            if at < len(known):
                gap = known[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    known.pop(at)
                taken = min(left, count)
                free(gap, first + taken, count - taken)
            else:
                gap, first = capacity, sequences
                taken = -(-left // (capacity // length))
                sequences += taken
            plan.append((length, rank, first, capacity - gap))
            free(gap - length, first, taken)
            rank, left = rank + taken, left - taken
    return plan


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """A row per piece; (part, place) ranks the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(enc.ids(text).astype("<u4"), np.uint32(END_ID)).astype("<u4")
                starts = cuts(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc, piece, a, b - a, crc32_ids(ids[a:b]), part, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pack every row of docs (doc_id, text) into as few sequences as best fit finds.

    A null text counts as empty (its end id alone); repeated rows and repeated ids are packed
    one by one; documents of equal length go in the order of their tasks and rows; a null doc_id
    stays null; other columns are ignored; an empty table gives an empty result. Texts are read
    whole; only rows longer than the capacity are cut.
    """
    spark = docs.sparkSession
    pieces = stage(encode_pieces(docs, tokenizer, capacity), "pack-pieces")
    runs = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-runs")
    counts = {r.length: r.n for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = sorted(plan_rounds(counts, capacity))
    shift = 1 << 44
    keys = np.array([a * shift + b for a, b, _, _ in plan], np.int64)
    table = spark.sparkContext.broadcast((keys, *(np.array([p[i] for p in plan], np.int64) for i in (1, 2, 3))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, firsts, offsets = table.value
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
                at = np.searchsorted(keys, length * shift + rank, side="right") - 1
                found = [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, "sequence_id", "offset"])

    # the runs grow with the tasks, so they are never broadcast: both sides are dealt by part and length
    ranked = pieces.join(runs.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out)

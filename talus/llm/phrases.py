"""Phrase collocations by Rabin-Karp fingerprints.

Texts (A-Z lower-cased) are cut into pieces at `.,;:!?` and line ends and into words at spaces
and tabs. Words have 64-bit values; prefix sums of the polynomial sum(value_j * B^j), all in
numpy, give the fingerprint of the n words from i as (S[i+n] - S[i]) * B^-i, whatever the place.

A task works on chunks of CHUNK words. Two kinds of rows leave a chunk:

* for screening, its distinct fingerprints with their counts, packed as bytes by ranges of the
  fingerprint; a shuffle brings a range together and fingerprints that reach the least count stay;
* for each phrase of a fingerprint that may have stayed, (lang, size, fp, n) with a pointer to an
  occurrence (doc_id, place of the first word). Equal fingerprints of a chunk are verified word by
  word, the words at the pointer are taken from the text, and the shuffle adds up by fingerprint
  and words, so phrases whose fingerprints collide part there and every count is exact.

Words and pairs are screened first, then triples and fours of which all pairs stayed (a phrase
is never more frequent than its parts), so only frequent phrases become text. "May have stayed"
asks a bitmap of at most 2^28 bits (32 MB), which never denies one that did; beyond the number of
phrases it is made for it only saves less. No result depends on it.

Null texts are empty; a null lang is `und`; repeated rows and ids count row by row; very long
texts are read in sections; equal scores go by count, then by phrase; an empty table or one
without frequent phrases gives no rows; doc_id and other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.text import binary, mix, slices
from talus.runtime import stage

#: Words of a chunk, bytes that a long text is split by, entries of a worker's word table, bits of a bitmap at most.
CHUNK, SEGMENT, WORDS, BITS = 500_000, 4 << 20, 400_000, 28
#: Fingerprints that a screening task holds before it adds them up, and has in all as a rule.
MERGED, SCREENED = 4_000_000, 8_000_000
LONGEST, LEAST, PERCENT, TOP = 4, 30, 80, 2000
#: Stands for the end of a piece; no UTF-8 text has this byte.
END = b"\xff"
_PIECES = bytes(0xFF if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else b for b in range(256))
_BLANK = re.compile(b"[ \t\xff]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIZES = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_PHRASES = "lang string, size int, fp long, phrase string, n long, doc_id long, at int"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with END after each piece, in lists of about SEGMENT bytes."""
    text = text.lower().translate(_PIECES)
    start = 0
    while start < len(text):
        found = _BLANK.search(text, start + SEGMENT) if len(text) - start > SEGMENT else None
        stop = found.start() if found else len(text)
        yield text[start:stop].replace(END, b" \xff ").split()
        start = stop


def sections(text: bytes, most: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(place of the first word, words, how many of them begin phrases here): sections overlap by LONGEST - 1 words."""
    held, at = [], 0
    for more in words(text):
        held = held + more if held else more
        while len(held) >= most + LONGEST - 1:
            yield at, held[: most + LONGEST - 1], most
            held, at = held[most:], at + most
    if held:
        yield at, held, len(held)


class Words(dict):
    """word -> number, END being 0, with the words' 64-bit values."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[END] = 0
        self.values_: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.values_)
        self.values_.append(xxhash.xxh3_64_intdigest(word))
        return number


class Bitmap:
    """Says of a fingerprint whether it may be frequent."""

    def __init__(self, bits: int, blocks: list[tuple[int, bytes]]):
        self.bits = bits
        self.table = np.zeros(max(1 << bits, 1 << 15) >> 3, np.uint8)
        for number, block in blocks:
            self.table[(number - 1) * 4096 : number * 4096] = np.frombuffer(block, np.uint8)[: len(self.table)]

    def has(self, fp: np.ndarray) -> np.ndarray:
        found = np.ones(len(fp), bool)
        for shift in (0, 32):
            at = ((fp >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            found &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def bitmap(fps: DataFrame) -> Bitmap:
    """The bitmap of a table of distinct fingerprints, built block by block on the executors."""
    bits = min(BITS, max(15, (16 * fps.count()).bit_length()))
    places = fps.select(F.explode(F.array("fp", F.shiftrightunsigned("fp", 32))).alias("p")).select((F.col("p").bitwiseAND((1 << bits) - 1) + 1).alias("p"))
    blocks = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    return Bitmap(bits, [(r.b, bytes(r.m)) for r in blocks.collect()])


class Chunk:
    """Words of several documents one after the other, with an END after each section."""

    def __init__(self):
        self.numbers: list[np.ndarray] = []
        self.words: list[bytes] = []
        self.begins: list[int] = []  # place in the chunk of each section
        self.ids: list[int | None] = []
        self.offsets: list[int] = []
        self.limits: list[int] = []
        self.langs: list[str] = []
        self.length = 0

    def add(self, doc_id: int | None, lang: str, at: int, found: list[bytes], numbers: np.ndarray, begin: int) -> None:
        self.begins.append(self.length)
        self.ids.append(doc_id)
        self.langs.append(lang)
        self.offsets.append(at)
        self.limits.append(self.length + begin)
        self.numbers += [numbers, np.zeros(1, np.int64)]
        self.words += found
        self.words.append(END)
        self.length += len(numbers) + 1


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n, kept for the next chunk."""
    if len(_POWERS.get(base, ())) <= n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 8, base, np.uint64)]), dtype=np.uint64)
    return _POWERS[base]


class Counted:
    """A chunk's arrays: where phrases begin, and their fingerprints."""

    def __init__(self, chunk: Chunk, values: np.ndarray, mask: int):
        self.chunk, self.mask = chunk, np.uint64(mask)
        self.numbers = np.concatenate(chunk.numbers)
        n = len(self.numbers)
        begins = np.array(chunk.begins)
        self.section = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
        self.names, lang = np.unique(np.array(chunk.langs, object).astype(str), return_inverse=True)
        self.lang = lang[self.section]
        self.salt = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in self.names], np.uint64)[self.lang]
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.numbers] * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, n)
        self.starts = np.arange(n) < np.array(chunk.limits)[self.section]
        self.word = self.numbers > 0
        self.known: dict[int, np.ndarray] = {}

    def fingerprints(self, size: int) -> np.ndarray:
        """Of the `size` words from each place on: of their prefix polynomials, the size and the lang."""
        if size not in self.known:
            n = max(0, len(self.numbers) - size + 1)
            with np.errstate(over="ignore"):
                self.known[size] = mix(((self.sums[size : size + n] - self.sums[:n]) * self.inverse[:n]) ^ _SIZES[size] ^ self.salt[:n]) & self.mask
        return self.known[size]

    def places(self, size: int, pairs: np.ndarray | None = None) -> np.ndarray:
        """Where phrases of this size begin; with pairs, only those whose pairs all have the mark."""
        n = len(self.numbers) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        valid = self.starts[:n].copy()
        for k in range(size):
            valid &= self.word[k : n + k]
        for k in range(size - 1 if pairs is not None else 0):
            valid &= pairs[k : n + k]
        return np.flatnonzero(valid)

    def totals(self) -> pa.RecordBatch:
        """All words of each lang, as rows of size 0."""
        n = np.bincount(self.lang[self.word & self.starts], minlength=len(self.names))
        k = len(n)
        columns = [pa.array(self.names.astype(object), pa.string()), pa.array([0] * k, pa.int32()), pa.array([0] * k, pa.int64()), pa.array([""] * k), pa.array(n), pa.nulls(k, pa.int64()), pa.array([0] * k, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "fp", "phrase", "n", "doc_id", "at"])

    def phrases(self, size: int, at: np.ndarray) -> pa.RecordBatch:
        """A row for each distinct phrase that begins at one of the places."""
        fp = self.fingerprints(size)[at]
        _, first, which, counts = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        lead = at[first][which]
        same = self.lang[at] == self.lang[lead]
        for k in range(size):
            same &= self.numbers[at + k] == self.numbers[lead + k]
        if not same.all():  # different phrases of one fingerprint part here
            full = np.stack([self.lang[at], *(self.numbers[at + k] for k in range(size))], axis=1)
            _, first, counts = np.unique(full, axis=0, return_index=True, return_counts=True)
        lead, c = at[first], self.chunk
        section = self.section[lead]
        words_ = c.words
        text = [b" ".join(words_[i : i + size]) for i in lead.tolist()] if size > 1 else [words_[i] for i in lead.tolist()]
        columns = [
            pa.array(self.names[self.lang[lead]].astype(object), pa.string()), pa.array(np.full(len(lead), size, np.int32)), pa.array(fp[first].view(np.int64)), pa.array(text, pa.binary()).cast(pa.string()),
            pa.array(counts.astype(np.int64)), pa.array([c.ids[i] for i in section.tolist()], pa.int64()), pa.array((lead - np.array(c.begins)[section] + np.array(c.offsets)[section]).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "fp", "phrase", "n", "doc_id", "at"])


def _chunks(batches: Iterator[pa.RecordBatch], chunk_words: int, mask: int) -> Iterator[Counted]:
    known, chunk = Words(), Chunk()
    for batch in slices(batches, "text"):
        for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), binary(batch.column("text"))):
            for at, found, begin in sections(text, chunk_words):
                chunk.add(doc_id, lang, at, found, np.fromiter(map(known.__getitem__, found), np.int64, len(found)), begin)
                if chunk.length >= chunk_words:
                    yield Counted(chunk, np.array(known.values_, np.uint64), mask)
                    chunk = Chunk()
                    if len(known) > WORDS:
                        known.forget()
    if chunk.length:
        yield Counted(chunk, np.array(known.values_, np.uint64), mask)


def _packed(fps: list[np.ndarray], buckets: int, least: int) -> pa.RecordBatch:
    """Distinct fingerprints and counts (no higher than needed) as bytes, a row for each bucket."""
    fp, counts = np.unique(np.concatenate(fps), return_counts=True)
    bucket = ((fp >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascending, as fp is
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    counts = np.minimum(counts, least).astype(np.uint32 if least > 255 else np.uint8)
    rows = [b for b in range(buckets) if edges[b] < edges[b + 1]]
    cut = lambda a: pa.array([a[edges[b] : edges[b + 1]].tobytes() for b in rows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), cut(fp), cut(counts)], ["bucket", "fps", "counts"])


def often(packed: DataFrame, least: int, parts: int) -> DataFrame:
    """(fp): the fingerprints whose counts reach the least."""
    kind = np.uint32 if least > 255 else np.uint8

    def merge(fps: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fp, which = np.unique(np.concatenate(fps), return_inverse=True)
        return fp, np.minimum(np.bincount(which, np.concatenate(counts), len(fp)), least).astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, kind)], 0
        for batch in batches:
            for f, c in zip(batch.column("fps"), batch.column("counts")):
                fps.append(np.frombuffer(f.as_buffer(), np.uint64))
                counts.append(np.frombuffer(c.as_buffer(), kind))
                held += len(fps[-1])
                if held > MERGED:
                    fp, n = merge(fps, counts)
                    fps, counts, held = [fp], [n], 0
        fp, n = merge(fps, counts)
        yield pa.RecordBatch.from_arrays([pa.array(fp[n >= least].view(np.int64))], ["fp"])

    return packed.repartition(parts, "bucket").mapInArrow(run, "fp long")


def screened(docs: DataFrame, sizes: tuple[int, ...], pairs: Bitmap | None, least: int, parts: int, chunk_words: int, mask: int) -> DataFrame:
    """(fp): the fingerprints of frequent phrases of these sizes, of frequent pairs only if a bitmap is given."""
    buckets = 4 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chunk_words, mask):
            marks = pairs.has(c.fingerprints(2)) if pairs is not None else None
            yield _packed([c.fingerprints(size)[c.places(size, marks)] for size in sizes], buckets, least)

    return often(docs.mapInArrow(run, "bucket int, fps binary, counts binary"), least, parts)


def materialised(docs: DataFrame, sizes: tuple[int, ...], stayed: Bitmap, chunk_words: int, mask: int) -> DataFrame:
    """(lang, size, fp, phrase, n, doc_id, at): each chunk's phrases whose fingerprints may have stayed, and its words as size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chunk_words, mask):
            yield c.totals()
            for size in sizes:
                at = c.places(size)
                at = at[stayed.has(c.fingerprints(size)[at])]
                if len(at):
                    yield c.phrases(size, at)

    return docs.mapInArrow(run, _PHRASES)


def phrase_counts(docs: DataFrame, least: int = LEAST, chunk_words: int = CHUNK, mask: int = (1 << 64) - 1) -> DataFrame:
    """(lang, size, phrase, f, first): all phrases of 1 to 4 words with f >= least, and all words of a lang as size 0.

    first points to an occurrence (doc_id, at: the word's place, ends of pieces counted). mask cuts
    fingerprints short, for tests.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")).where("text IS NOT NULL AND text <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has six bytes as a rule; twice as many fingerprints as words are screened at most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 3 // SCREENED + 1)
    first = stage(screened(rows, (1, 2), None, least, parts, chunk_words, mask), "phrases-often")
    pairs = bitmap(first)
    second = stage(screened(rows, (3, 4), pairs, least, parts, chunk_words, mask), "phrases-often")
    stayed = bitmap(first.unionByName(second))
    found = materialised(rows, (1, 2, 3, 4), stayed, chunk_words, mask)
    counts = found.groupBy("lang", "size", "fp", "phrase").agg(F.sum("n").alias("f"), F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"))
    return stage(counts.where((F.col("f") >= least) | (F.col("size") == 0)).select("lang", "size", "phrase", "f", F.struct("doc_id", "at").alias("first")), "phrases-counts")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, chunk_words: int = CHUNK, mask: int = (1 << 64) - 1) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's `top` phrases by their weakest cut."""
    found = phrase_counts(docs, least, chunk_words, mask)
    counts, total = found.where("size > 0"), found.where("size = 0").select("lang", F.col("f").alias("n"))
    long = counts.where("size >= 2").withColumn("w", F.split("phrase", " ", -1))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("rest")
    )
    of = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    # decimals: the product may pass 64 bits
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20)) * 2000000) div (CAST(l AS DECIMAL(20)) + r)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = long.where("size >= 3").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(20)) * 100 < CAST(a AS DECIMAL(20)) * {percent}")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

"""Token counts of whole texts: batches in Arrow functions that return lengths only.

Batches are cut so that each holds about the same number of bytes. Long texts are split where no
token can lie across: with a sentencepiece vocabulary, at a space that follows another character
(the library puts that space back in front of the next part itself) and before a line feed, as
far as the vocabulary has no piece across such a place and the model changes no characters; the
lengths of the parts add up to the whole text's. A model for which this does not hold gets whole
texts. Parts that were seen before are not encoded again; the table of them is bounded.

Null texts are empty (0 bytes, 0 tokens); a text of spaces has the library's tokens for it;
repeated rows and null ids are counted row by row; texts without a safe place are encoded
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import tokens
from talus.llm.text import slices

#: Bytes of a batch, characters of a segment of a long text, entries and longest key of the table of parts.
BATCH_BYTES, SEGMENT, KNOWN, KEY = 2 << 20, 1 << 18, 400_000, 64
#: A space after a character that is no space: nothing is merged across its front.
_CUT = re.compile(r"(?<=[^ ]) ")
#: Spelled as the library shows a space; it treats both alike.
_SHOWN = "▁"


class PieceLengths:
    """lengths(texts) with a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = "ﬁ  ́e　Ａ x\n y"
        plain = self.model.normalize(probe) == _SHOWN + probe.replace(" ", _SHOWN)
        #: cuts at spaces and before line feeds are safe
        self.spaces = plain and not any(re.search(f"[^{_SHOWN}]{_SHOWN}", v) for v in vocabulary)
        self.feeds = self.spaces and not any("\n" in v for v in vocabulary)
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> Iterator[str]:
        """The text in segments of about SEGMENT characters, without the spaces at the cuts."""
        start = 0
        while len(text) - start > SEGMENT and (found := _CUT.search(text, start + SEGMENT)):
            yield text[start : found.start()]
            start = found.end()
        yield text[start:]

    def parts(self, segment: str) -> list[str]:
        """Parts whose lengths add up; one that begins with a line feed counts without its first space."""
        if not segment:
            return [""]
        bare = "  " not in segment and segment[0] != " " and segment[-1] != " "
        words = segment.split(" ") if bare else _CUT.split(segment)
        if not self.feeds or "\n" not in segment:
            return words
        out: list[str] = []
        for word in words:
            head, *lines = word.split("\n")
            out.append(head)
            out.extend(["\n" + x for x in lines])
        return out

    def encoded(self, parts: list[str]) -> list[int]:
        found = map(len, self.model.encode(parts, num_threads=1))
        return [self.lone if not p else n - (self.feeds and p[0] == "\n") for p, n in zip(parts, found)]

    def learn(self, parts: set[str]) -> dict[str, int]:
        """Put those parts into the table that are not in it, in one batch; the long ones are handed back."""
        fresh = [p for p in parts if p not in self.known]
        if len(self.known) + len(fresh) > KNOWN:
            self.known.clear()
            fresh = list(parts)
        found = dict(zip(fresh, self.encoded(fresh)))
        long = {p: found.pop(p) for p in fresh if len(p) > KEY}
        self.known.update(found)
        return long

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.spaces:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for segment in self.segments(text.replace(_SHOWN, " ")) if text else ():
                held.append((i, self.parts(segment)))
                size += len(segment)
                if size > BATCH_BYTES:
                    self.add(held, out)
                    held, size = [], 0
        self.add(held, out)
        return out

    def add(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        long = self.learn(set().union(*(parts for _, parts in held)))
        known = self.known
        for i, parts in held:
            if long:
                out[i] += sum(long[p] if p in long else known[p] for p in parts)
            else:
                out[i] += sum(map(known.__getitem__, parts))


class JsonLengths:
    """lengths(texts) with a file of the tokenizers library."""

    def __init__(self, path: str):
        self.encoder = tokens.TextEncoder(path)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(self.encoder.encode(t)) // self.encoder.dtype.itemsize for t in texts]


_COUNTERS: dict[str, PieceLengths | JsonLengths] = {}


def counter(path: str) -> PieceLengths | JsonLengths:
    """The worker's counter for a file; loaded once in a Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceLengths(path) if path.endswith(".model") else JsonLengths(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: n_tokens > limit), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            n = lengths.lengths([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.array(n, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")

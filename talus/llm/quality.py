"""Quality rules in DataFrame functions only: per-document rules and cross-document line frequency.

A line of a host (the source) that more than LINE_DOCS distinct documents hold is removed from
all of them; a document that loses too many of its words is depleted and rejected, and
keep_good() hands the others on without those lines. Documents with the same text are one
document here, so that copies of a text don't make its lines common. The limit is a number of
documents and no share, so a menu of a hot host's pages goes however large the host is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.text import packed
from talus.runtime import stage

SPACE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is removed if more than this number of distinct documents of the host hold it.
LINE_DOCS = 10
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.30
#: Parts that the documents with a common line are dealt into.
SALTS = 16


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPLIT, -1)).otherwise(F.array().cast("array<string>"))


def window_keys(words: Column, bits: Column) -> Column:
    """Sorted keys of the 3-word windows: the position in the low `bits`, a hash above it."""
    low = _low(bits)

    def key(i):
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

    n = F.size(words)
    return F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))).otherwise(F.array().cast("array<long>"))


def _low(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def _equal(words: Column, i: Column, j: Column) -> Column:
    """Whether the windows at two positions hold the same words."""
    return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))


def repeated_positions(words: Column, keys: Column, bits: Column) -> Column:
    """Sorted positions of the windows that occur twice or more.

    Windows are neighbours among the keys if their hashes are equal, and then their words are
    compared. Should two different windows have equal hashes, a text's windows are sorted by
    their words instead.
    """
    low = _low(bits)
    high = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: x.bitwiseAND(low).cast("int")
    by_hash = F.transform(F.filter(keys, lambda x, j: F.coalesce(high(x) == high(F.get(keys, j - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(keys, j + 1)), F.lit(False))), lambda x: place(x).cast("long"))
    mixed = F.exists(F.transform(keys, lambda x, j: (high(x) == high(F.get(keys, j + 1))) & ~_equal(words, place(x), place(F.get(keys, j + 1)))), lambda x: F.coalesce(x, F.lit(False)))
    spelled = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
    alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    by_words = F.transform(F.filter(spelled, lambda x, j: alike(x, F.get(spelled, j - 1)) | alike(x, F.get(spelled, j + 1))), lambda x: x["i"].cast("long"))
    return F.sort_array(F.when(mixed, by_words).otherwise(by_hash))


def position_bits(words: Column) -> Column:
    """As many bits as the text's positions need; all others are the hash's."""
    return F.length(F.bin(F.size(words).cast("long"))).cast("int")


def covered(positions: Column) -> Column:
    """Words in the windows at the sorted positions, each word once."""
    each = F.transform(positions, lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(positions, j + 1) - p, F.lit(3).cast("long"))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def tidied(line: Column) -> Column:
    """A line as it is compared: trimmed, single spaces, lower case, digits as 0."""
    return F.translate(F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACE)), SPLIT, " ")), "0123456789", "0000000000")


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in the array; a null array leaves it as it is."""
    has_words = lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0
    left = F.filter(F.split(text, "\n", -1), lambda x: ~(has_words(x) & F.array_contains(gone, F.xxhash64(tidied(x)))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def row_key(doc_id: Column, text: Column, host: Column) -> Column:
    """The hash of a row's id, text and host."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")), F.coalesce(host.cast("string"), F.lit("\x00")))


def features(docs: DataFrame) -> DataFrame:
    """A row per row of docs with its base counts and its distinct normalised lines (hash, words)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    bare = F.length(F.translate(text, SPACE, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    one = base.select(
        "doc_id", "host", row_key(F.col("doc_id"), text, F.col("host")).alias("row_key"), F.xxhash64("text").alias("text_key"), words_of(text).alias("words"),
        bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    two = one.withColumn("bits", position_bits(F.col("words"))).withColumn("keys", window_keys(F.col("words"), F.col("bits")))
    three = two.withColumn("positions", repeated_positions(F.col("words"), F.col("keys"), F.col("bits")))
    tidy = F.transform("lines", tidied)
    counted = three.withColumn("tidy", tidy)
    per_line = F.transform("tidy", lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ", -1)).cast("long").alias("words")))
    return counted.select(
        "doc_id", "host", "row_key", "text_key", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("positions")).alias("n_repeat_words"), per_line.alias("per_line"),
    )


def quality(docs: DataFrame, limit: int = LINE_DOCS, left: float = LEFT_SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text, source): counts, base_failed, removed_words, kept, row_key, removed_lines.

    removed_lines holds the hashes of the lines that go, null if none does; see without_lines().
    Null and empty texts have no words and fail the base rules; a null source is a host of its
    own; a null doc_id is a value like others; rows that repeat id, text and source get equal
    rows; other columns are ignored; an empty table gives no rows. Texts are read whole,
    however long.
    """
    made = stage(features(docs), "quality-features")
    host = F.coalesce("host", F.lit("\x00"))
    lines = made.select(host.alias("host"), "row_key", "text_key", F.explode("per_line").alias("l")).select("host", "row_key", "text_key", "l.line", "l.words")
    common = lines.groupBy("host", "line").agg(F.count_distinct("text_key").alias("docs")).where(F.col("docs") > limit)
    # a common line is in many rows: each is dealt out in SALTS parts
    salted = lines.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
    common = common.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hit = salted.join(common, ["host", "line", "salt"]).groupBy("row_key", "line", "words").agg(F.count("*").alias("times"))
    # repeated rows double `times` and their own number alike
    rows = made.groupBy("row_key").agg(F.count("*").alias("rows")).where("rows > 1")
    removed = hit.join(rows, "row_key", "left").groupBy("row_key").agg(F.sum(F.col("words") * F.col("times") / F.coalesce("rows", F.lit(1))).cast("long").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = made.drop("per_line", "host", "text_key").join(removed, "row_key", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    depleted = (F.col("n_words") - F.col("removed_words")) < F.col("n_words") * left
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "removed_words", "row_key", "removed_lines")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep, their text without the host's common lines.

    Texts that lose no line stay as they are; n_chars, if there is one, is counted again where a line went.
    """
    good = quality(docs).where("kept").select("row_key", "removed_lines").distinct()
    key = row_key(F.col("row.doc_id"), F.col("row.text"), F.col("row.source"))
    left = docs.select(packed(docs).alias("row")).withColumn("row_key", key).join(good, "row_key")
    text = without_lines(F.col("row.text"), F.col("removed_lines"))

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(F.col("removed_lines").isNull(), old).otherwise(F.length(text).cast(docs.schema[name].dataType)).alias(name)
        return old.alias(name)

    return left.select(*[column(c) for c in docs.columns])

"""Packed token files, WARC archives and vector near-duplicates."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talus.llm import bitpack, embeddings, files, tokens, warc
from talus.runtime import new_path, table


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(bits, ids):
    x = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    data = bitpack.pack_bits(x, bits)
    assert len(data) == -(-len(x) * bits // 8) and bitpack.unpack_bits(data, len(x), bits).tolist() == x.tolist()


def test_file_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n, dtype=np.uint32) for n in (0, 1, 5000, 17, 0, 9000)]
    for bits in (16, 17):
        f = bitpack.PackedFile(b"".join(bitpack.file_bytes([3, None, 5, 6, 7, 8], docs, bits, 1000)))
        for k in (5, 2, 0, 3, 1, 4):
            assert f.document(k).tolist() == docs[k].tolist()
        assert f.known.tolist() == [1, 0, 1, 1, 1, 1]


def test_token_files_round_trip(docs_of):
    rows = [(9, "nine"), (2, "two words"), (5, None), (7, ""), (2, "two again"), (None, "no id"), (11, "long one " * 5000)]
    enc = tokens.encoder(tokens.default_path())
    got = bitpack.round_trip(docs_of(rows).withColumn("start", F.lit("x")), tokens.default_path()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 7, 9, 11]
    at, want = 0, sorted((i if i is not None else -1, tuple([*enc.ids(t).tolist(), 2])) for i, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == sorted((i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert bitpack.round_trip(docs_of(rows).where("false"), tokens.default_path()).count() == 0


def test_records_are_read_in_linear_time():
    import gzip
    import time

    body = "".join(random.Random(1).choices("abcdefgh", k=2000)).encode()

    def took(n):
        data = gzip.compress(body, 1) * n
        began = time.perf_counter()
        assert sum(1 for _ in warc.records(data)) == n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 12 * took(4_000)


def test_loser_tree():
    rng = random.Random(3)
    for k in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com/A?b=1") == "com,example)/a?b=1" and warc.url_key(None) == "" and warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key("not a url") == "not a url" and warc.url_key("http://[bad") == "http://[bad"


def page_rows():
    big, other = "<p>" + "x" * 200 + "</p>", "<p>" + "é" * 120 + "</p>"
    return [
        (5, "http://b.org/", big), (3, "http://a.org/x", big), (9, None, big), (4, "http://a.org/\r\nX: y", other), (8, "http://a.org/x", other), (1, "http://a.org/x", "short"),
        (2, "http://c.org", "short"), (6, "http://d.org", None), (7, "http://d.org", ""), (10, "http://e.org", "y" * 300_000), (11, "http://e.org", "head\r\n\r\nbody" * 20), (3, "http://a.org/x", big),
    ]


def test_warc_round_trip(spark):
    rows = page_rows()
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(0))).collect()
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        if len(b) >= 100 and first.setdefault(d, i) != i:
            want.append((i, len(b), d, "revisit", first[d]))
        else:
            want.append((i, len(b), d, "response", None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    order = sorted(got, key=lambda r: (r.index_part, r.index_place))
    assert [r.url_key for r in order] == sorted(r.url_key for r in got)


def test_runs_are_merged_in_levels_and_ranges(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("RANGE_BLOCKS", 5), ("FAN", 3), ("ARCHIVE_BYTES", 3000), ("DRAWN", 4), ("CHUNK", 500)):
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(7)
    rows = [(i, f"http://h{rng.randrange(9) if rng.random() < 0.7 else 0}.org/{rng.randrange(4)}", f"body {i} " * 20) for i in range(900)] + [(None, "http://h1.org/1", "x"), (5, "http://h0.org/0", "again"), (5, "http://h0.org/0", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = new_path(spark, "warc-levels")
    blocks = warc.write(pages, path)
    assert blocks.select("run").distinct().count() > 9  # three levels
    index = warc.merge_runs(blocks, path).collect()
    assert len({r.part for r in index}) > 3
    index.sort(key=lambda r: (r.part, r.place))
    seen = [(r.key, r.stamp, -1 if r.page_id is None else r.page_id) for r in index]
    assert seen == sorted(seen) and len(seen) == len(rows)
    nth = {}
    for r in index:
        assert r.capture == nth.get(r.key, 0)
        nth[r.key] = r.capture + 1
    got = warc.read(warc.merge_runs(blocks, path)).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes) for r in got) == sorted((-1 if i is None else i, len(h.encode())) for i, _, h in rows)


def test_archives_are_gzip_members(spark):
    path = new_path(spark, "warc-test")
    index = warc.merge_runs(warc.write(spark.createDataFrame(page_rows(), "page_id long, url string, html string"), path), path).collect()
    assert len(index) == len(page_rows())
    for r in index:
        data = files.read(r.file)
        body = zlib.decompress(data[r.offset : r.offset + r.length], 31)
        assert body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and warc.parse(body)["page_id"] == r.page_id
        assert (r.offset, r.length, body) in set(warc.records(data))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def vectors():
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in range(3):
        for _ in range(25):
            base = rng.standard_normal(32)
            for noise in (0.0, 0.0, 0.2, 0.3, 0.4, 0.5):
                rows.append((n, [float(v) for v in (base + noise * rng.standard_normal(32)).astype(np.float32)], label))
                n += 1
    return rows + [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [], 1), (n + 3, [1.0, None] + [0.0] * 30, 0), (n + 4, [float("nan")] * 32, 0), (n + 5, [1.0] * 32, None), (n + 6, [float("inf")] * 32, 1), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0)]


def brute(rows):
    ok = [(i, np.array(v), l) for i, v, l in rows if v and l is not None and all(x is not None for x in v) and np.isfinite(np.array(v)).all() and any(v)]
    n, up = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, l), (j, y, m) = ok[a], ok[b]
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= embeddings.THRESHOLD:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return n, {i: find(i) for i in n}


def test_vector_links_against_all_pairs(spark):
    rows = vectors()
    n, c = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("component_id", F.lit("x"))
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows) and all(r.n_links <= n[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n.values())
    assert sum(got[i].component_id == c[i] for i in c) >= 0.99 * len(c) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_many_small_groups_near_the_threshold(spark):
    """Pairs whose cosines lie around the threshold, in many groups of 2 to 5."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for group in range(250):
        base = rng.standard_normal(48)
        for _ in range(2 + group % 4):
            rows.append((n, [float(v) for v in base + rng.uniform(0.1, 0.3) * rng.standard_normal(48)], group % 3))
            n += 1
    want, c = brute(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(want.values()) > 500 and all(r.n_links <= want[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(want.values())
    assert sum(got[i].component_id == c[i] for i in c) >= 0.98 * len(c)


def test_extreme_doubles_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(k, [s * v for v in (1.0, 2.0, -3.0)], 1) for k, s in enumerate((1e200, 3e-200, 1.0, 5e-324, 1e307))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: (4, 0) for k in range(5)}
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (3, [0.01, 1.0], 1), (4, [1.0, -1.0], 1), (5, [1.0, 0.0], 2)]
    for turn in range(3):
        random.Random(turn).shuffle(rows)
        got = sorted({(r.vec_id, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()})
        assert got == [(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True)]


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3, 24))
    rows = [(i, [float(v) for v in base[i % 3] + 0.1 * rng.standard_normal(24)], 1) for i in range(200)]
    n, c = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (n[i], c[i]) for i in n}


def test_one_large_group_of_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in (base if i % 2 else base + 0.02 * rng.standard_normal(16))], 1) for i in range(1300)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.n_links for r in got} == {1299} and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("name", ["embeddings"])
def test_empty_vectors(spark, sf, name):
    assert embeddings.near_duplicate_vectors(table(spark, sf, name).where("false")).count() == 0

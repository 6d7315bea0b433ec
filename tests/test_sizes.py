"""What fails on large tables only: limits, units and work that grows faster than the rows."""

import datetime as dt
import json
import random

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from talus.functions import text
from talus.operators import boosting, features, graph
from talus.plans import catalog, storage
from talus.sources import rest
from talus.streaming import pipelines as st
from talus.streaming import state


catalog.load()


def test_a_source_of_known_length_has_no_limit_of_pages(spark, tmp_path):
    d, n = str(tmp_path), 2 * rest.MAX_OFFSET_PAGES + 3
    spark.range(n).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("c_name")).write.parquet(f"{d}/customer.parquet")
    rows = storage._served(spark, d, 2, partitions=7)
    assert sorted(r.c_custkey for r in rows.collect()) == list(range(n))


def test_time_to_live_counts_microseconds(spark):
    at = [dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 20, 0, 0, 0, 1), dt.datetime(2024, 1, 20, 0, 0, 0, 999_999), dt.datetime(2024, 1, 19, 23, 59, 59, 999_999), None]
    df = spark.createDataFrame(list(enumerate(at)), "id long, ts timestamp_ntz")
    assert sorted(r.id for r in st.within_ttl(df, "ts", F.lit("2024-02-29").cast("timestamp"), 40).collect()) == [1, 2]


def test_a_batch_of_a_cursor_stream_takes_many_pages_and_reads_them_again(spark):
    schema = spark.createDataFrame([], "user_id long").schema

    def fetch(url):
        at = int(url or 0)
        return 200, {}, json.dumps({"data": [{"user_id": i} for i in range(at, min(at + 5, 97))], "nextCursor": at + 5 if at + 5 < 97 else None})

    for least, batches in ((1, 20), (20, 5), (30, 4), (1000, 1)):
        stream = rest._Stream(schema, {"url": "{cursor}", "batchrows": str(least)}, fetch)
        start, seen, n = stream.initialOffset(), [], 0
        while not start["done"]:
            rows, end = stream.read(start)
            rows = list(rows)
            assert list(stream.readBetweenOffsets(start, end)) == rows
            start, seen, n = end, seen + rows, n + 1
        assert seen == [(i,) for i in range(97)] and n == batches
        assert list(stream.read(start)[0]) == []


def test_boosting_passes_walk_few_trees_and_add_up_many_tasks(spark, monkeypatch):
    df = spark.range(600).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.sin("id") + F.cos(F.col("id") * 3) > 0.2).cast("int").alias("y"), F.pmod("id", F.lit(3)).cast("int").alias("fold"))
    settings = [boosting.Setting(fold=f, trees=9, depth=4, step=0.3, rows=0.8) for f in (0, 1, None)]
    one = boosting.train(df, "id", "y", ["a", "b"], settings, "fold")
    walked, plain = [], boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda *a: (walked.append((a[4] - a[5], a[9])), plain(*a))[1])
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    many = boosting.train(df, "id", "y", ["a", "b"], settings, "fold")
    assert max(trees for trees, _ in walked) < 4 and not any(single for _, single in walked)
    for a, b in zip(one, many):
        assert [(t.feature, t.cut) for t in a.trees] == [(t.feature, t.cut) for t in b.trees] and len(a.trees) == 9
        assert all(abs(x - y) < 1e-9 for t, v in zip(a.trees, b.trees) for x, y in zip(t.value, v.value))


def test_hops_over_shared_keys_are_those_of_the_edges_and_make_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(60)}", rng.randrange(90)) for _ in range(220)] + [("alone", 500), ("far1", 600), ("far1", 601), (None, 1), ("k1", None), ("hot", 7)] + [("hot", u) for u in range(200, 260)]
    members = spark.createDataFrame(rows, "key string, user_id long")
    for listed in ([0, 7, 17, 205, 210, 211, 500], [600], []):
        seeds = spark.createDataFrame([(x,) for x in listed], "node long")
        want = sorted(map(tuple, features.graph_hops(graph.symmetric(graph.shared_key_edges(members, "key")), seeds).collect()))
        assert sorted(map(tuple, features.key_hops(members, "key", seeds).collect())) == want
        m = graph.key_members(members, "key")
        counts = {r.node: r.n for r in graph.neighbour_counts(graph.symmetric(graph.shared_key_edges(members, "key")), seeds).collect()}
        assert {r.node: r.n for r in graph.key_neighbour_counts(m, seeds, block=50).collect()} == counts
    left = pa.table({"k": [1, 1, 2, 2, 3], "node": [5, 6, 5, 7, 9]})
    for pairs in (1, 2, 1000):
        monkeypatch.setattr(graph, "PAIRS", pairs)
        assert graph._distinct_listed(left, left.slice(0, 4)).to_pydict() == {"node": [5, 6, 7], "n": [2, 1, 1]}


def test_masks_are_the_plain_patterns_and_pass_over_texts_that_need_none(spark):
    edge, d = text.EDGE, r"\p{Nd}"
    plain = (rf"{edge}{d}{{1,3}}(?:\.{d}{{1,3}}){{3}}{edge}", rf"{edge}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{edge}", rf"{edge}09{d}{{8}}{edge}", rf"\+{d}{{8,15}}{edge}", rf"{edge}[A-Z][12]{d}{{8}}{edge}")
    rng, bits = random.Random(5), ["1.2.3.4", "a.b@c.de", "+x@y.org", "0912345678", "+886912345678", "A123456789", "Ä", "é", "٠٩", "..@x.yz", "_", "-", ".", " ", "5", "\n"]
    df = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for i in range(3000)] + [(-1, None)], "id long, text string")
    want = df
    for (name, _, tag), pattern in zip(text.MASKS, plain):
        want = want.withColumn(f"n_{name}", F.regexp_count("text", F.lit(pattern))).withColumn("text", F.regexp_replace("text", pattern, tag))
    got = text.redacted(df, "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert set(text.NEEDED) == {"ip", "email", "mobile", "phone"}


def test_the_recursion_and_the_component_join_read_written_edges(spark):
    d = "/root/testdata/sf0.001"
    for name in ("g2r_recursive_bfs", "j18_component_join"):
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan


def test_a_key_has_one_timer_for_the_rows_of_a_batch():
    class Kept:
        def __init__(self):
            self.timers, self.rows, self.calls, self.value = [], [], 0, None

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def getListState(self, *a):  # noqa: N802
            return self

        getValueState = getListState  # noqa: N815

        def appendList(self, rows):  # noqa: N802
            self.rows, self.calls = self.rows + rows, self.calls + 1

        def appendValue(self, row):  # noqa: N802
            self.appendList([row])

    kept, one = Kept(), state.OnceInTtl(10)
    one.init(kept)
    list(one.handleInputRows((1,), iter([Row(ts=t, ord=t) for t in (7, 3, 9, 3)]), None))
    assert kept.timers == [3] and kept.calls == 1 and sorted(kept.rows) == [(3, 3), (3, 3), (7, 7), (9, 9)]

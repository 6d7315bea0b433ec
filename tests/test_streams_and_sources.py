"""Keyed state, ordered delivery, stream metrics, sources and sinks that restart, discovery, salted frontiers."""

import collections
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from talus.operators import graph
from talus.runtime import new_path
from talus.sources import discovery, keyed, rest
from talus.streaming import delivery, state
from talus.streaming import pipelines as st

DAY = 86_400_000


def files_of(spark, rows, schema, parts):
    """A folder with one file for each part, in this order."""
    p = new_path(spark, "t-in")
    for k in range(parts):
        spark.createDataFrame([r for i, r in enumerate(rows) if i % parts == k] or [], schema).coalesce(1).write.mode("append").parquet(p)
    return p


def once_by_hand(rows, ttl):
    """(key, ord) that are taken, of (key, milliseconds, ord)."""
    until, out = {}, set()
    for key, at, order in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in until or at >= until[key]:
            until[key] = at + ttl
            out.add((key, order))
    return out


def test_once_in_ttl_with_a_restart(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), rng.randrange(0, 40) * DAY // 4, k) for k in range(200)]
    rows += [(9, 0, 900), (9, 2 * DAY - 1, 901), (9, 2 * DAY, 902), (9, 2 * DAY, 903), (7, 100 * DAY, 904)]
    rows = [(k, ms + 10 * DAY, e) for k, ms, e in rows]
    schema = "user_id long, ts timestamp, event_id long"
    stamp = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)
    src, out, at = (new_path(spark, f"t-{x}") for x in ("src", "out", "at"))
    ordered = sorted(rows, key=lambda r: r[1])
    with state.keyed_state(spark):
        for part in (ordered[:90], ordered[90:-1], ordered[-1:]):  # runs on the same checkpoint; the last row moves the watermark on
            data = [(k, stamp(ms), e) for k, ms, e in random.Random(2).sample(part, len(part))]
            spark.createDataFrame(data, schema).repartition(3).write.mode("append").parquet(src)
            stream = state.once_in_ttl(st.file_stream(spark, src, spark.createDataFrame([], schema).schema), "user_id", "ts", "event_id", 2 * 86_400, "20 days")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r.key, r.ord) for r in spark.read.schema("key long, ord long, accepted long").parquet(out).collect()]
    want = once_by_hand([r for r in rows if r[1] <= 90 * DAY], 2 * DAY)
    assert len(got) == len(set(got)) and set(got) == want and {(9, 900), (9, 902)} <= set(got)


def machine_by_hand(actions):
    now, out = collections.defaultdict(lambda: "OPEN"), set()
    for key, seq, action in sorted(actions):
        after = st.TRANSITIONS.get((now[key], action))
        now[key] = after or now[key]
        out.add((key, seq, action, now[key], 200 if after else 409))
    return out


def test_states_of_actions_that_come_out_of_order_and_twice(spark):
    rng = random.Random(4)
    actions = [(k, s, rng.choice(["review", "confirm", "dismiss", "other"])) for k in range(6) for s in range(1, 12)]
    late = [(99, 2, "confirm"), (99, 3, "review")]  # 1 never comes: these wait
    rows = rng.sample(actions + late, len(actions) + 2) + actions[:20]
    schema = "incident_id long, seq long, action string"
    p = files_of(spark, rows, schema, 4)
    with state.keyed_state(spark):
        out = st.run_to_table(state.machine_states(st.file_stream(spark, p, spark.createDataFrame([], schema).schema)))
    got = [tuple(r) for r in out.select("incident_id", "seq", "action", "state", "code").collect()]
    assert len(got) == len(set(got)) and set(got) == machine_by_hand(actions)


class _Kept:
    """A value or map state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self._call("" in self.rows)

    def get(self):
        return self._call(self.rows.get(""))

    def update(self, value):
        self._call(self.rows.update({"": value}))

    def containsKey(self, key):  # noqa: N802
        return self._call(key in self.rows)

    def getValue(self, key):  # noqa: N802
        return self._call(self.rows[key])

    def updateValue(self, key, value):  # noqa: N802
        self._call(self.rows.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._call(self.rows.pop(key, None))

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815


class _Handle(_Kept):
    def __init__(self):
        self.value, self.map = _Kept(), _Kept()

    def getValueState(self, *_):  # noqa: N802
        return self.value

    def getMapState(self, *_):  # noqa: N802
        return self.map


def test_actions_that_wait_are_kept_by_blocks():
    """A key's batches take calls by blocks, and what comes out is the same for any order and any block."""
    rng = random.Random(8)
    actions = [(7, s, rng.choice(["review", "confirm", "dismiss", "other"])) for s in range(1, 6001)]
    dealt = rng.sample(actions, len(actions))
    batches = [dealt[k::3] for k in range(3)]
    row = collections.namedtuple("row", "seq action ref")
    for settings, most in (({}, 120), ({"block": 16, "held": 500}, None)):
        handle, machine = _Handle(), state.Machine(st.TRANSITIONS, "OPEN", **settings)
        machine.init(handle)
        got = []
        for batch in batches + [dealt[:50]]:  # the last repeats what was taken
            for out in machine.handleInputRows((7,), iter([row(s, a, -s) for _, s, a in batch]), None):
                first, *columns = (out.first, out.action, out.state, out.code, out.ref) if hasattr(out, "first") else (out.seq, [out.action], [out.state], [out.code], [None])
                got += [(7, first + i, *one) for i, one in enumerate(zip(*columns))]
        assert [g[1] for g in got] == list(range(1, 6001)) and {g[:5] for g in got} == machine_by_hand(actions) and all(g[5] == -g[1] for g in got)
        assert not handle.map.rows and (most is None or handle.value.calls + handle.map.calls <= most)


def test_state_is_dealt_by_rows_and_takes_a_reference_along(spark):
    rng = random.Random(9)
    actions = [(k, s, rng.choice(["review", "confirm", "dismiss"])) for k, n in ((1, 2500), (2, 3)) for s in range(1, n + 1)]
    rows = [(k, s, a, f"e{k}-{s}") for k, s, a in rng.sample(actions, len(actions))]
    schema = "incident_id long, seq long, action string, event string"
    p = files_of(spark, rows, schema, 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with state.keyed_state(spark, 3_000_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "6"
        out = st.run_to_table(state.machine_states(st.file_stream(spark, p, spark.createDataFrame([], schema).schema), ref="event"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    got = [tuple(r) for r in out.select("incident_id", "seq", "action", "state", "code", "event").collect()]
    assert len(got) == len(set(got)) and {g[:5] for g in got} == machine_by_hand(actions) and all(g[5] == f"e{g[0]}-{g[1]}" for g in got)


def delivered_by_hand(rows, fails, attempts):
    done, dead = [], []
    for group, seq, kind in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        tries = next((k for k in range(1, attempts + 1) if k > fails(kind)), None)
        (done if tries else dead).append((group, seq, tries or attempts))
    return done, dead


FAILS = {"ok": 0, "once": 1, "twice": 2, "never": 99}


def queue_of(spark, p, schema, attempts, path=None):
    ok = lambda attempt: attempt > F.when(F.col("kind") == "ok", 0).when(F.col("kind") == "once", 1).when(F.col("kind") == "twice", 2).otherwise(99)
    return delivery.Delivery(st.file_stream(spark, p, spark.createDataFrame([], schema).schema), "g", "seq", ok, attempts, path)


@pytest.mark.parametrize("attempts", [1, 2, 3])
def test_delivery_keeps_the_order_and_moves_dead_letters(spark, attempts):
    rng = random.Random(attempts)
    rows = [(rng.choice([1, 2, None]), k, rng.choice(["ok", "ok", "once", "twice", "never"])) for k in range(40)]
    schema = "g long, seq long, kind string"
    p = files_of(spark, [], schema, 0)
    for k in range(2):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(p)
    q = queue_of(spark, p, schema, attempts).run()
    done, dead = delivered_by_hand(rows, FAILS.get, attempts)
    got = q.table("delivered").collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.g, r.seq, r.attempts) for r in got], key=key) == done
    assert sorted([(r.g, r.seq, r.attempts) for r in q.table("dead").collect()], key=key) == dead and q.table("pending").isEmpty()
    for g in (1, 2, None):  # first in, first out
        places = sorted((r.position, r.seq) for r in got if r.g == g)
        assert [p for p, _ in places] == list(range(1, len(places) + 1)) and [s for _, s in places] == sorted(s for _, s in places)


@pytest.mark.parametrize(("attempts", "most"), [(2, 2), (20, 6)])
def test_steps_of_a_delivery_dont_grow_with_the_failures_of_a_group(spark, attempts, most):
    """Twelve failures in one group; more attempts than a step takes: two of its messages fail for good."""
    kinds = ["once", "ok", "once", "once", "never", "once", "once", "ok", "once", "never", "once", "once", "once", "once"]
    rows = [(1, k, kind) for k, kind in enumerate(kinds)] + [(None, 0, "once"), (2, 0, "ok")]
    schema = "g long, seq long, kind string"
    q = queue_of(spark, files_of(spark, rows, schema, 1), schema, attempts).run()
    done, dead = delivered_by_hand(rows, lambda kind: FAILS[kind], attempts)
    got = q.table("delivered").collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r.g, r.seq, r.attempts) for r in got], key=key) == done and sorted([(r.g, r.seq, r.attempts) for r in q.table("dead").collect()], key=key) == dead
    assert [r.seq for r in sorted(got, key=lambda r: r.position) if r.g == 1] == [s for g, s, _ in done if g == 1]
    assert len(q._batches()) <= most


def test_a_delivery_batch_that_runs_again_leaves_each_row_once(spark):
    rows = [(1, k, k_) for k, k_ in enumerate(["ok", "once", "ok", "never", "ok"])]
    schema = "g long, seq long, kind string"
    p = files_of(spark, rows, schema, 1)
    q = queue_of(spark, p, schema, 2)
    batch = spark.createDataFrame(rows, schema)
    q._step(batch, 0)
    before = sorted(map(tuple, q.table("pending").collect()))
    assert [r[1] for r in before] == [1, 2, 3, 4] and before[0][3] == 1
    q._step(batch, 0)
    assert sorted(map(tuple, q.table("pending").collect())) == before and q.table("delivered").count() == 1
    for _ in range(2):
        q._step(batch.limit(0), 1)
    assert q.table("delivered").count() == 3 and [r.seq for r in q.table("pending").collect()] == [3, 4]


def test_metrics_name_the_batch_that_calls_for_an_alert(spark):
    schema = "k long, bad boolean"
    p = new_path(spark, "t-metrics")
    for total, bad in ((10, 1), (10, 2), (5, 0)):
        spark.createDataFrame([(i, i < bad) for i in range(total)], schema).coalesce(1).write.mode("append").parquet(p)
    alerts = []
    start = lambda df: df.writeStream.format("noop").option("checkpointLocation", new_path(spark, "t-at")).trigger(availableNow=True).start()
    got = delivery.monitored(st.file_stream(spark, p, spark.createDataFrame([], schema).schema), F.col("bad"), start, alert=alerts.append)
    assert [tuple(r) for r in got.collect()] == [(0, 10, 1, 0.1, False), (1, 10, 2, 0.2, True), (2, 5, 0, 0.0, False)]
    assert [a["batch"] for a in alerts] == [1]


class _Pages(rest.RestSource):
    """Rows 0 .. n - 1, n read from a file that the test changes; every page notes who asked for it."""

    @classmethod
    def name(cls):
        return "t_pages"

    def schema(self):
        return "user_id bigint"

    @staticmethod
    def fetch(url):
        import os
        import threading

        folder, offset, limit = url.split("|")
        n = int(open(f"{folder}/n").read())
        with open(f"{folder}/asked-{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(f"{offset}/{limit}\n")
        rows = [{"user_id": i} for i in range(int(offset), min(n, int(offset) + int(limit)))]
        return 200, {}, json.dumps({"data": rows, "total": n})


def test_offset_stream_restarts_and_reads_pages_on_executors(spark, tmp_path):
    spark.dataSource.register(_Pages)
    out, at = new_path(spark, "t-pages"), new_path(spark, "t-pages-at")
    for n in (25, 25, 61):
        (tmp_path / "n").write_text(str(n))
        stream = spark.readStream.format("t_pages").option("url", f"{tmp_path}|{{offset}}|{{limit}}").option("pagesize", 10).option("partitions", 3).load()
        st.drained(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start())
        assert sorted(r.user_id for r in spark.read.schema("user_id long").parquet(out).collect()) == list(range(n))
    asked = {f.name: f.read_text().split() for f in tmp_path.glob("asked-*")}
    drivers = [f for f, lines in asked.items() if "0/1" in lines]
    assert drivers and all(set(asked[f]) == {"0/1"} for f in drivers)  # the total is all that the driver asks for


def test_offset_partitions_cover_the_range_by_whole_pages():
    r = rest._OffsetStream(None, {"url": "{offset}", "pagesize": "10", "partitions": "4"}, None)
    for first, last in ((0, 0), (0, 7), (3, 95), (20, 21), (19, 41)):
        parts = [(p.first, p.end) for p in r.partitions({"rows": first}, {"rows": last})]
        assert [i for a, b in parts for i in range(a, b)] == list(range(first, last)) and len(parts) <= 5
        assert all(a % 10 == 0 for a, _ in parts[1:])


SCHEMA = "k long, v string"


def keyed_rows(spark, path):
    return sorted(tuple(r) for r in keyed.read_keyed(spark, path, "k", SCHEMA).collect())


def test_keyed_sink_takes_each_key_once_whatever_fails(spark):
    spark.dataSource.register(keyed.KeyedSink)
    p = new_path(spark, "t-keyed")
    put = lambda df: df.write.format("talus_keyed").mode("append").option("path", p).option("key", "k").save()
    assert keyed_rows(spark, p) == []
    put(spark.createDataFrame([(k, "a") for k in range(10)], SCHEMA).repartition(3))
    bad = spark.range(5, 15, 1, 4).select(F.col("id").alias("k"), F.when(F.col("id") == 14, F.raise_error(F.lit("lost")).cast("string")).otherwise("b").alias("v"))
    with pytest.raises(Exception, match="lost"):
        put(bad)
    assert keyed_rows(spark, p) == [(k, "a") for k in range(10)]
    put(spark.createDataFrame([(k, "c") for k in range(8, 12)], SCHEMA))
    put(spark.createDataFrame([], SCHEMA))
    assert keyed_rows(spark, p) == [(k, "a") for k in range(8)] + [(k, "c") for k in range(8, 12)]


def test_keyed_files_of_other_attempts_are_not_seen(spark, tmp_path):
    files = keyed._Files({"path": f"file://{tmp_path}", "key": "k"}, spark.createDataFrame([], SCHEMA).schema)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": [1, 2], "v": ["x", "y"]})
    lost, taken = files.write(iter([batch])), files.write(iter([batch]))  # one task, two attempts
    files.publish([taken], "stream-000000000000")
    files.publish([taken], "stream-000000000000")  # the batch is committed again
    assert lost.files != taken.files and keyed_rows(spark, f"file://{tmp_path}") == [(1, "x"), (2, "y")]
    files.discard([lost])
    with pytest.raises(ValueError):
        keyed._Files({"path": "x", "key": "none"}, spark.createDataFrame([], SCHEMA).schema)


def test_keyed_stream_restarts(spark):
    spark.dataSource.register(keyed.KeyedSink)
    src, out, at = (new_path(spark, f"t-ks-{x}") for x in ("src", "out", "at"))
    for k in range(2):
        spark.createDataFrame([(i, f"run{k}") for i in range(5 * k, 5 * k + 8)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        st.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema).writeStream.format("talus_keyed").option("path", out).option("key", "k").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    assert keyed_rows(spark, out) == [(i, "run0" if i < 5 else "run1") for i in range(13)]


def test_a_crawl_reads_new_folders_only_and_keeps_the_schema(spark):
    root, at = new_path(spark, "t-crawl"), new_path(spark, "t-manifest")
    assert discovery.crawl(spark, root, at).rows.columns == []
    spark.range(3).withColumn("x", F.lit("a")).write.parquet(f"{root}/dt=2024-01-01")
    spark.range(2).write.csv(f"{root}/dt=2024-01-09")
    one = discovery.crawl(spark, root, at)
    assert one.rows.count() == 3 and set(one.rows.columns) == {"id", "x", "dt"}
    again = discovery.crawl(spark, root, at)
    assert again.rows.count() == 0 and again.rows.columns == one.rows.columns and again.log == []
    spark.range(10, 12).withColumn("y", F.lit(1.5)).write.parquet(f"{root}/dt=2024-01-02")
    two = discovery.crawl(spark, root, at)
    assert sorted((r.id, r.x, r.y) for r in two.rows.collect()) == [(10, None, 1.5), (11, None, 1.5)]
    assert ("column", "y", "double") in two.log and any(k == "absent" and n == "x" for k, n, _ in two.log)
    jvm = spark.sparkContext._jvm
    gone = jvm.org.apache.hadoop.fs.Path(f"{root}/dt=2024-01-01")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    three = discovery.crawl(spark, root, at)
    assert ("gone", "dt=2024-01-01", "") in three.log and "x" in three.rows.columns
    spark.range(1).withColumn("x", F.lit("back")).write.parquet(f"{root}/dt=2024-01-01")
    assert [r.x for r in discovery.crawl(spark, root, at).rows.collect()] == ["back"]
    assert discovery.crawl(spark, root, at).log == []


def test_salted_frontiers_find_the_same_distances(spark):
    star = [(0, k) for k in range(1, 300)] + [(k, k + 1000) for k in range(1, 300)] + [(5000, 0), (7000, 7001)]
    edges = graph.symmetric(spark.createDataFrame(star, "src long, dst long"))
    seeds = spark.createDataFrame([(5000, 1), (7000, 1), (299, 2)], "node long, fold int")
    plain = {(r.fold, r.node): r.hops for r in graph.distances(edges, seeds, 3, keys=("fold",)).collect()}
    salted = {(r.fold, r.node): r.hops for r in graph.distances(edges, seeds, 3, keys=("fold",), hot_edges=20).collect()}
    assert plain == salted and plain[1, 1001] == 3 and plain[2, 0] == 1 and (1, 7001) in plain
    hops = graph.Hops(edges, 20)
    per_part = hops.edges.groupBy("src", "salt").count().agg(F.max("count")).first()[0]
    assert hops.any and {(r.node, r.salts) for r in hops.hot.collect()} == {(0, 15)} and per_part <= 45


def test_capped_cliques_take_the_smallest_users(spark):
    members = spark.createDataFrame([("k", u) for u in range(100, 0, -1)] * 2 + [("one", 5), (None, 6), ("k", None)], "key string, user_id long")
    got = {(r.src, r.dst) for r in graph.shared_key_edges(members, "key", cap=4).collect()}
    assert got == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}

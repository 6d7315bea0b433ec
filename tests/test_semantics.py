"""Hand-made cases for what is easily got wrong: ties, closures, isolated seeds, repeats, nulls."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from talus.functions import clean, risk, text
from talus.operators import evaluate, events, features, graph, ml, validate
from talus.plans import catalog, world
from talus.sources import rest
from talus.streaming import pipelines


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def edges_of(spark, pairs):
    return graph.symmetric(spark.createDataFrame(pairs, "src long, dst long"))


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_path_hops(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    assert rows(graph.distances(e, nodes_of(spark, [1])), "node", "hops") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(features.graph_hops(e, nodes_of(spark, [1])), "user_id", "min_hops_to_blacklist")[-1] == (5, 4)


def test_isolated_seed_has_two_meanings(spark):
    e = edges_of(spark, [(1, 2)])
    assert (9, 0) in rows(graph.distances(e, nodes_of(spark, [1, 9])), "node", "hops")
    assert (9, 0) not in rows(graph.distances(e, nodes_of(spark, [1, 9]), keep_isolated_seeds=False), "node", "hops")


def test_shared_ip_is_two_hops_or_one(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a")], "user_id long, ip string")
    assert dict(rows(graph.distances(graph.symmetric(graph.bipartite(m, "ip")), nodes_of(spark, [1])), "node", "hops"))[2] == 2
    assert dict(rows(graph.distances(graph.symmetric(graph.shared_key_edges(m, "ip")), nodes_of(spark, [1])), "node", "hops"))[2] == 1


def test_clique_of_up_to_fifty_users_a_key(spark):
    catalog.load()
    sf = "/root/testdata/sf0.01"
    of = {}
    for r in world.events(spark, sf).select("source_ip", "user_id").distinct().where("source_ip IS NOT NULL AND user_id IS NOT NULL").collect():
        of.setdefault(r.source_ip, []).append(r.user_id)
    assert max(map(len, of.values())) > 50
    want = {p for users in of.values() for p in itertools.combinations(sorted(users)[:50], 2)}
    assert rows(catalog.QUERIES["j5_capped_clique_50"](spark, sf), "src", "dst") == sorted(want)
    few = {p for users in of.values() for p in itertools.combinations(sorted(users)[:5], 2)}
    print(len(few), len(want), sum(math.comb(min(5, len(u)), 2) for u in of.values()), sum(math.comb(min(50, len(u)), 2) for u in of.values()))


def test_long_chain_is_one_component(spark):
    e = edges_of(spark, [(i, i + 1) for i in range(1, 26)] + [(100, 101)])
    assert {c for _, c in rows(graph.components(e), "node", "component")} == {1, 100}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_against_plain_python(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(1, 60), r.randrange(1, 60)) for _ in range(50)]
    seeds = [r.randrange(1, 60) for _ in range(3)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, frontier = {s: 0 for s in seeds}, set(seeds)
    for hop in (1, 2, 3):
        frontier = {y for x in frontier for y in near.get(x, ())} - set(want)
        want |= {x: hop for x in frontier}
    e, s = edges_of(spark, pairs), nodes_of(spark, seeds)
    for f in (graph.distances, graph.distances_unrolled, graph.distances_recursive):
        assert dict(rows(f(e, s), "node", "hops")) == want
    least = {}
    for start in sorted(near):
        stack = [start] if start not in least else []
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = start
                stack += near[x]
    assert dict(rows(graph.components(e), "node", "component")) == least


def test_retention_is_strictly_later(spark):
    t = lambda m: f"2024-01-01 10:{m:02d}:00"
    make = lambda r: spark.createDataFrame(r, "user_id long, created_at string, kind int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = features.retention(make([(1, t(0), 0), (1, t(5), 0), (2, t(0), 0)]), make([(1, t(0), 1), (1, t(7), 1)]))
    assert rows(got, "user_id", "min_retention_minutes", "retention_event_count", "high_speed_risk") == [(1, 2.0, 2, True), (2, None, 0, False)]


def test_repeated_relations_count_twice(spark):
    r = spark.createDataFrame([(1, 2), (1, 2)], "src long, dst long")
    none = spark.createDataFrame([], "key string, user_id long")
    assert rows(graph.relation_counts(r, none, nodes_of(spark, [2])), "node", "n") == [(1, 2)]
    assert rows(graph.neighbour_counts(graph.symmetric(r), nodes_of(spark, [2])), "node", "n") == [(1, 1)]


def test_kyc_variants(spark):
    d = spark.createDataFrame([(None, "x"), ("x", "x"), ("nan", "NaT")], "a string, b string")
    assert [r[0] for r in d.select(clean.kyc_level(F.col("a"), F.col("b"))).collect()] == [2, 2, 2]
    assert [r[0] for r in d.select(clean.kyc_level_text(F.col("a"), F.col("b"))).collect()] == [0, 2, 0]


def test_group_of_one_has_no_zscore(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    assert [r.zscore for r in events.zscore(d, "g", "v").where("g = 'a'").collect()] == [None]


def test_tiers_and_bins(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (0.65,), (0.75,), (0.9,), (0.91,)], "p double")
    assert [r[0] for r in d.select(risk.tier(F.col("p"))).collect()] == ["LOW", "MEDIUM", "BOUNDARY", "BOUNDARY", "HIGH", "EXTREME"]
    assert [r[0] for r in d.select(risk.probability_bin(F.col("p"))).collect()] == [None, "(0.3, 0.5]", "(0.5, 0.65]", "(0.65, 0.75]", "(0.75, 0.9]", "(0.9, 1]"]


def test_night_variants(spark):
    d = spark.createDataFrame([(f"2024-01-01 {h:02d}:30:00",) for h in (5, 6, 21, 22)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in d.select(events.is_night(F.col("t"))).collect()] == [True, True, False, True]
    assert [r[0] for r in d.select(events.is_night(F.col("t"), 5)).collect()] == [True, False, False, True]


def test_equal_times_keep_the_later_position(spark):
    d = spark.createDataFrame([(1, "t", 0, "a"), (1, "t", 1, "b")], "user_id long, at string, pos int, v string")
    assert [r.v for r in events.latest(d, "user_id", "at", "pos").collect()] == ["b"]


def test_submission_failures(spark):
    s = spark.createDataFrame([(1, 0), (1, 1), (2, 2)], "user_id long, status int")
    want = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    assert rows(validate.submission_problems(s, want), "problem", "n") == [("duplicate id", 1), ("missing id", 1), ("status outside 0 and 1", 1)]
    assert validate.submission_problems(s.drop("status"), want).first().problem == "missing column status"


def test_redaction_masks(spark):
    t = "203.69.21.88 wang.xiaoming@fake.tw 0912345678 +886912345678 A234567890"
    got = spark.createDataFrame([(t,)], "t string").select(text.redact(F.col("t"))).first()[0]
    assert got == "[IP-REDACTED] [EMAIL-REDACTED] [PHONE-REDACTED] [PHONE-REDACTED] [ID-REDACTED]"


def test_context_filter(spark):
    kept = {"min_retention_minutes": "8.5", "twd_withdraw_count": "12", "crypto_withdraw_count": "6", "min_hops_to_blacklist": "1", "ip_shared_user_count": "9", "has_high_speed_risk": "true", "hop_risk_level": "direct", "weighted_risk_label": "HIGH_WEIGHTED", "kyc_level": "0"}
    gone = {"source_ip": "1.2.3.4", "full_name": "x", "email": "a@b.c", "phone": "1", "wallet_address": "0x"}
    d = spark.createDataFrame([(kept | gone,)], "m map<string,string>")
    assert d.select(text.allowed_context(F.col("m"))).first()[0] == kept


def test_perfect_and_tied_scores(spark):
    d = spark.createDataFrame([(0.9, 1), (0.1, 0)], "p double, y int")
    assert evaluate.roc_auc(d).first().auc == 1.0
    assert evaluate.roc_auc(d.withColumn("p", F.lit(0.5))).first().auc == 0.5
    assert evaluate.roc_auc(d.where("y = 1")).first().auc is None


def test_perturbed_features_stay_in_bounds(spark):
    d = spark.createDataFrame([(i, 14399.0, 1.0, 5.0, 4.0, 0.99) for i in range(20)], "user_id long, min_retention_minutes double, unique_ip_count double, total_twd_volume double, min_hops_to_blacklist double, night_tx_ratio double")
    out = ml.perturbed(d, "combined", 0.8)
    for c, (lo, hi) in risk.BOUNDS.items():
        if c in out.columns:
            assert out.where((F.col(c) < lo) | (F.col(c) > hi)).count() == 0


def test_scaling_and_parsing(spark):
    d = spark.createDataFrame([("123456789",), ("None",), ("x",), (None,)], "amount string")
    assert [r.amount for r in clean.scale_amounts(d).collect()] == [1.23456789, None, None, None]
    t = spark.createDataFrame([(" YES",), ("0",), (None,)], "t string")
    assert [r[0] for r in t.select(clean.truth(F.col("t"))).collect()] == [True, False, None]


def test_more_hops_than_three(spark):
    e = edges_of(spark, [(i, i + 1) for i in range(1, 12)] + [(3, 20), (20, 21)])
    want = {1: 0, 2: 1, 3: 2, 4: 3, 20: 3, 5: 4, 21: 4, 6: 5, 7: 6}
    for f in (graph.distances, graph.distances_recursive):
        assert dict(rows(f(e, nodes_of(spark, [1]), max_hops=6), "node", "hops")) == want


def test_reads_that_are_not_whole_raise():
    page = lambda o, n: [{"i": k} for k in range(o, min(25, o + n))]
    assert sum(len(p) for p in rest.offset_pages(page, 5, max_pages=5)) == 25
    with pytest.raises(rest.IncompleteRead):
        list(rest.offset_pages(page, 5, max_pages=4))
    assert sum(len(p) for p in rest.offset_pages(page, 5, max_pages=4, partial=True)) == 20
    failing = lambda o, n: None if o else page(o, n)
    with pytest.raises(rest.IncompleteRead):
        list(rest.offset_pages(failing, 10))
    assert [len(p) for p in rest.offset_pages(failing, 10, partial=True)] == [10]
    by_cursor = lambda c: {"data": page(int(c or 0), 5), "next": int(c or 0) + 5 if int(c or 0) < 20 else None}
    assert sum(len(r) for _, r in rest.cursor_pages(by_cursor)) == 25
    with pytest.raises(rest.IncompleteRead):
        list(rest.cursor_pages(by_cursor, max_pages=3))
    with pytest.raises(rest.IncompleteRead):
        list(rest.cursor_pages(lambda c: None))


def test_waits_of_a_table_equal_the_function(spark):
    data = [(c, a, h) for c in (400, 403, 404, 429, 500, 503) for a in (0, 1, 5, 9) for h in (None, "7", "soon")]
    d = spark.createDataFrame(data, "c int, a int, h string")
    got = [r[0] for r in d.select(rest.wait_column(F.col("c"), F.col("a"), F.col("h"))).collect()]
    assert got == [rest.wait_seconds(*x) for x in data]


def test_upsert_goes_on_after_a_stop(spark, tmp_path):
    schema = "k long, at long, v string"
    table, mark, src = (f"{tmp_path}/{x}" for x in ("table", "mark", "in"))
    want = {}
    for turn, batch in enumerate(([(i, 1, "a") for i in range(40)], [(i, 2, "b") for i in range(5)] + [(99, 1, "new")], [(3, 0, "old")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        for k, at, v in batch:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        got = pipelines.upsert_latest(pipelines.file_stream(spark, src, schema), "k", "at", path=table, checkpoint=mark, buckets=4)
        assert {r.k: (r["at"], r.v) for r in got.collect()} == want
        files = {p for _, p in pipelines._batches_of(spark, table)}
        assert files == set(range(turn + 1))
    assert len([1 for b, n in pipelines._batches_of(spark, table) if n == 2]) == 1  # the last batch rewrote its one bucket only


def test_a_failing_query_is_not_written_elsewhere(spark, tmp_path):
    from talus.sources import sinks

    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.with_fallback(bad, f"{tmp_path}/a", f"{tmp_path}/b")
    assert not (tmp_path / "b").exists()


def test_tree_contributions_add_up_to_the_margin(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    r = random.Random(3)
    data = [(i, r.random(), r.random(), r.random()) for i in range(300)]
    d = spark.createDataFrame([(i, a, b, c, int(a + 0.3 * b > 0.7)) for i, a, b, c in data], "id long, a double, b double, c double, y int")
    ready = ml.assembled(d, ["a", "b", "c"])
    model = GBTClassifier(maxIter=6, maxDepth=4, seed=1).fit(ready.select(F.col("y").cast("double").alias("label"), "features"))
    margins = {x.id: x.m for x in model.transform(ready).select("id", (vector_to_array("rawPrediction")[1]).alias("m")).collect()}
    got = ml.tree_contributions(d, "id", model, ["a", "b", "c"]).collect()
    for x in got:
        assert math.isclose(x.margin, margins[x.id], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(x.base + sum(c.contribution for c in x.contributions), x.margin, rel_tol=1e-9, abs_tol=1e-9)
    size = {f: sum(abs(c.contribution) for x in got for c in x.contributions if c.feature == f) for f in "abc"}
    assert size["a"] > size["b"] > size["c"]


def test_fold_aware_features_hide_a_folds_labels(spark):
    """A pair of neighbours has the same label and else nothing to tell it by: seeds of all rows would give it away."""
    n, k = 120, 3
    rows_ = [(i, int(i % 8 in (0, 1)), 0.0) for i in range(n)]
    d = spark.createDataFrame(rows_, "id long, y int, x double")
    dealt = events.folds(d, "id", "y", k)
    edges = edges_of(spark, [(i, i + 1) for i in range(0, n, 2)]).where("src < 1000")
    of_fold = {r.id: r.fold for r in dealt.collect()}
    got = {(r.for_fold, r.id): (r.hops, r.listed) for r in ml.fold_graph_features(dealt, "id", "y", edges, k).collect()}
    assert len(got) == n * k
    for (f, i), (hops, listed) in got.items():
        other = i + 1 if i % 2 == 0 else i - 1
        seed = rows_[other][1] == 1 and of_fold[other] != f
        assert (hops, listed) == ((1, 1) if seed else (4, 0))
    scored = {r.id: r.p for r in ml.fold_aware(d, "id", "y", ["x"], edges, k=k, trees=2, depth=2).collect()}
    leaky = ml.fold_graph_features(dealt.withColumn("fold", F.lit(-1)), "id", "y", edges, 1).select("id", "hops", "listed")
    plain = {r.id: r.p for r in ml.out_of_fold(d.join(leaky, "id"), "id", "y", ["x", "hops", "listed"], k=k, trees=2, depth=2).collect()}
    hidden = [i for i, y, _ in rows_ if y == 1 and of_fold[i + 1 if i % 2 == 0 else i - 1] == of_fold[i]]
    assert hidden and all(plain[i] > 0.5 > scored[i] for i in hidden)


def test_rows_without_a_label_get_the_folds_mean(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else int(i % 3 == 0), float(i % 3)) for i in range(90)], "id long, y int, x double")
    got = ml.out_of_fold(d, "id", "y", ["x"], k=3, trees=2, depth=2).collect()
    assert sorted(r.id for r in got) == list(range(90))
    assert all((r.fold is None) == (r.y is None) == (r.id % 5 == 0) for r in got)
    assert all((r.p > 0.5) == (r.id % 3 == 0) for r in got)


def test_spans_are_replaced_from_the_back(spark):
    d = spark.createDataFrame([("Ann Lee, Main St 5", [(0, 7), (9, 18)]), ("none", []), ("null", None), ("ab", [(1, 1)])], "t string, s array<struct<begin:int,end:int>>")
    assert [r[0] for r in d.select(text.redact_spans(F.col("t"), F.col("s"))).collect()] == ["[REDACTED], [REDACTED]", "none", "null", "a[REDACTED]b"]


def test_pages_and_retries():
    short = list(rest.offset_pages(lambda o, n: [{"i": k} for k in range(o, min(25, o + n))], 10))
    assert [len(p) for p in short] == [10, 10, 5]
    answers = iter([(500, {}, ""), (429, {"Retry-After": "7"}, ""), (200, {}, "[1]")])
    waits = []
    assert rest.get("u", lambda _: next(answers), waits.append) == [1] and waits == [1.0, 7.0]
    assert rest.get("u", lambda _: (404, {}, ""), waits.append) is None


def test_incident_conflicts(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "review"), (1, 2, "confirm"), (1, 3, "confirm"), (2, 1, "dismiss")], "incident_id long, seq long, action string")
    a.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = pipelines.run_to_table(pipelines.incident_states(pipelines.file_stream(spark, f"{tmp_path}/in", a.schema)))
    assert rows(got, "incident_id", "seq", "state", "code") == [(1, 1, "UNDER_REVIEW", 200), (1, 2, "CONFIRMED", 200), (1, 3, "CONFIRMED", 409), (2, 1, "FALSE_POSITIVE", 200)]


def test_ranks_over_partitions_equal_one_window(spark):
    from talus.operators.ranks import row_numbers, running_sums

    r = random.Random(8)
    data = [(i, "a" if r.random() < 0.8 else None, r.randrange(100)) for i in range(500)]
    d = spark.createDataFrame(data, "id long, g string, v long").repartition(7)
    got = {x.id: (x.rank, x.total) for x in running_sums(row_numbers(d, [F.col("v"), F.col("id")], ["g"]), [F.col("v"), F.col("id")], {"total": "v"}).collect()}
    total, seen = 0, {}
    for i, g, v in sorted(data, key=lambda x: (x[2], x[0])):
        total, seen[g] = total + v, seen.get(g, 0) + 1
        assert got[i] == (seen[g], total)


def test_next_after_of_a_hot_key(spark):
    r = random.Random(9)
    data = [(i, 1 if r.random() < 0.9 else r.randrange(5), r.randrange(60), r.random() < 0.5) for i in range(800)]
    d = spark.createDataFrame(data, "id long, u long, t long, start boolean").repartition(6)
    args = ("u", "t", F.col("start"), ~F.col("start"))
    want = {i: min((t2 for _, u2, t2, s2 in data if u2 == u and not s2 and t2 > t), default=None) for i, u, t, s in data if s}
    assert {x.id: x.next_end for x in events.next_after(d, *args).collect()} == want
    assert {x.id: x.next_end for x in events.next_after_split(d, *args).collect()} == want


class _Cursor(rest.RestSource):
    @classmethod
    def name(cls):
        return "talus_rest_cursor"

    @staticmethod
    def fetch(url):
        import json

        at = int(url.split("/")[-1] or 0)
        return 200, {}, json.dumps({"data": [{"user_id": i} for i in range(at, at + 5)], "nextCursor": at + 5 if at < 20 else None})


def test_cursor_stream_reads_every_row_once(spark, tmp_path):
    import tests.test_semantics as here

    spark.dataSource.register(here._Cursor)
    q = spark.readStream.format("talus_rest_cursor").option("url", "x/{cursor}").load().writeStream.format("memory").queryName("cursor_rows").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.user_id for r in spark.table("cursor_rows").collect()) == list(range(25))


def test_gaps_of_a_hot_key_are_the_plain_ones(spark):
    r = random.Random(8)
    data = [(0 if r.random() < 0.6 else r.choice([1, 2, None]), r.choice([None, *range(40)]), i) for i in range(400)]
    d = spark.createDataFrame(data, "k long, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    plain, split = ({x.i: x.gap_seconds for x in f(d, "k", "ts", "i").collect()} for f in (events.gaps, events.gaps_split))
    assert plain == split and len(plain) == 400
    assert events.has_hot_key(d, "k", 100) and not events.has_hot_key(d, "k") and not events.has_hot_key(d.limit(0), "k")


def test_masks_stop_at_words(spark):
    texts = ["20912345678", "x0912345678", "0912345678é", "é0912345678", "(0912345678)", "0912345678_", "B234567890", "BB234567890", "B2345678901", "v1.2.3.4", "1.2.3.4.5", "01.2.3.4", "a@b.co1", "a@b.co,", "+12345678x", "++12345678", "1+123456789012345", "mail:x.y@z.org."]
    rules = [(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[IP-REDACTED]"), (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL-REDACTED]"), (r"\b09\d{8}\b", "[PHONE-REDACTED]"), (r"\+\d{8,15}\b", "[PHONE-REDACTED]"), (r"\b[A-Z][12]\d{8}\b", "[ID-REDACTED]")]

    def want(t):
        for pattern, tag in rules:
            t = re.sub(pattern, tag, t)
        return t

    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] for x in d.select(text.redact(F.col("t"))).collect()] == [want(t) for t in texts]
    got = text.redacted(d.withColumn("u", F.col("t")), "t").collect()
    assert [x.t for x in got] == [want(t) for t in texts] and got[0].n_mobile == 0 and got[4].n_mobile == 1

"""Scans and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import clean, risk
from talus.operators.ranks import row_numbers
from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import new_path, table
from talus.sources import discovery, keyed, rest, scans, sinks

ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("sc1_csv_scan", ORDERS)
def sc1(s, d):
    p = new_path(s, "sc1")
    _orders(s, d).write.option("header", True).csv(p)
    return scans.csv(s, p).select(F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"), F.col("o_custkey").try_cast("bigint").alias("o_custkey"), F.col("o_totalprice").try_cast("double").alias("o_totalprice"))


@query("sc2_latest_partition", "SELECT o_orderkey FROM orders WHERE o_orderkey%3=2")
def sc2(s, d):
    p = new_path(s, "sc2")
    sinks.partitioned(_orders(s, d).withColumn("dt", F.concat(F.lit("2026-01-0"), (F.col("o_orderkey") % 3 + 1).cast("string"))), p, "dt")
    return scans.latest_partition(s.read.parquet(p)).select("o_orderkey")


@query("sc3_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity>45")
def sc3(s, d):
    return table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("sc4_header_csv_filter", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus='F'")
def sc4(s, d):
    p = new_path(s, "sc4")
    table(s, d, "orders").select("o_custkey", "o_orderstatus").write.option("header", True).csv(p)
    return scans.csv(s, p).where("o_orderstatus = 'F'").select(F.col("o_custkey").try_cast("bigint").alias("o_custkey")).distinct()


@query("sc5_feature_cache", ORDERS)
def sc5(s, d):
    p = new_path(s, "sc5")
    _orders(s, d).write.parquet(p)
    return scans.parquet(s, p)


class _Local(rest.RestSource):
    """The paged source over files in place of a network: a url names a folder of pages, each a JSON file that Spark wrote."""

    @classmethod
    def name(cls) -> str:
        return "talus_rest_local"

    def schema(self) -> str:
        return "c_custkey bigint, c_name string"

    @staticmethod
    def fetch(url):
        import pyarrow.fs as fs

        base, at = url.split("|")
        system, path = fs.FileSystem.from_uri(base.replace("file:/", "file:///", 1) if base.startswith("file:/") and "://" not in base else base)
        found = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/at={at or 0}", allow_not_found=True)) if f.path.endswith(".txt")]
        if not found:
            return 200, {}, '{"data": []}'
        with system.open_input_stream(found[0]) as f:
            return 200, {}, f.read().decode()


CUSTOMERS = "SELECT c_custkey, c_name FROM customer"


def _pages(s, d, size):
    """A folder of pages of the customers in the order of their keys, and how many rows there are."""
    c = table(s, d, "customer").select("c_custkey", "c_name")
    total = c.count()
    p = new_path(s, "pages")
    numbered = row_numbers(c, [F.col("c_custkey")], name="n").withColumn("at", F.floor((F.col("n") - 1) / size) * size)
    rows = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "c_custkey", "c_name"))), lambda x: F.struct(x["c_custkey"].alias("c_custkey"), x["c_name"].alias("c_name"))))
    after = F.col("at") + size
    tail = F.when(after < total, F.concat(F.lit(f', "total": {total}, "nextCursor": '), after.cast("string"))).otherwise(f', "total": {total}')
    paged = numbered.groupBy("at").agg(rows.alias("rows")).select("at", F.concat(F.lit('{"data": '), "rows", tail, F.lit("}")).alias("value"))
    paged.write.partitionBy("at").text(p)
    return p, total


def _served(s, d, size, **options):
    """All pages that there are, however many: the limit of the reader is for sources of unknown length."""
    s.dataSource.register(_Local)
    p, total = _pages(s, d, size)
    options["maxpages"] = max(1, -(-total // size))
    return s.read.format("talus_rest_local").option("url", f"{p}|{{offset}}").option("pagesize", size).options(**options).load()


@query("sc6_rest_single_page", CUSTOMERS)
def sc6(s, d):
    return _served(s, d, 1_000_000)


@query("sc7_rest_offset_pages", CUSTOMERS)
def sc7(s, d):
    return _served(s, d, 400, partitions=7)


@query("sc8_rest_cursor_pages", CUSTOMERS)
def sc8(s, d):
    """The stream reader: its cursor is the checkpoint's offset; the second run takes up where the first ended."""
    from talus.streaming import pipelines as st

    s.dataSource.register(_Local)
    stream = s.readStream.format("talus_rest_local").option("url", f"{_pages(s, d, 500)[0]}|{{cursor}}").load()
    out, at = new_path(s, "sc8"), new_path(s, "sc8-checkpoint")
    for _ in range(2):
        st.drained(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start())
    return s.read.schema(stream.schema).parquet(out)


@query("sc8_rest_partitioned_stream", CUSTOMERS)
def sc8b(s, d):
    """A stream whose pages are read on the executors, four partitions a batch; the second run takes up where the first ended."""
    from talus.streaming import pipelines as st

    s.dataSource.register(_Local)
    p, _ = _pages(s, d, 100)
    stream = s.readStream.format("talus_rest_local").option("url", f"{p}|{{offset}}").option("pagesize", 100).option("partitions", 4).load()
    out, at = new_path(s, "sc8b"), new_path(s, "sc8b-checkpoint")
    for _ in range(2):
        st.drained(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start())
    return s.read.schema(stream.schema).parquet(out)


@query("sc9_retry_policy", """
SELECT o_orderkey, CASE s WHEN 429 THEN CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 50 ELSE least(300.0, 30.0 * 2 ** a) END WHEN 500 THEN least(60.0, 2.0 ** a) WHEN 503 THEN least(60.0, 2.0 ** a) END AS wait
FROM (SELECT o_orderkey, [403, 404, 429, 500, 503, 400][CAST(o_orderkey % 6 AS INT) + 1] AS s, o_orderkey % 10 AS a FROM orders)""")
def sc9(s, d):
    key = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(x) for x in (403, 404, 429, 500, 503, 400)]), F.pmod(key, F.lit(6)).cast("int"))
    after = F.when(key % 7 == 0, (key % 50).cast("string")).when(key % 7 == 1, "soon")
    return table(s, d, "orders").select("o_orderkey", rest.wait_column(status, key % 10, after).alias("wait"))


@query("sc10_catalog_registration", "SELECT o_orderstatus, count(*) AS n, 3 AS partitions FROM orders GROUP BY 1")
def sc10(s, d):
    p = new_path(s, "sc10")
    name = f"t_orders_registered_{p[-32:]}"  # sessions that share a catalog don't share the name
    for statuses in (("O",), ("F", "P")):  # registered again when there are more partitions
        sinks.partitioned(table(s, d, "orders").where(F.col("o_orderstatus").isin(*statuses)).select("o_orderkey", "o_orderstatus"), p, "o_orderstatus", mode="append")
        scans.register(s, name, p, "o_orderkey bigint", "o_orderstatus string")
    found = s.sql(f"SHOW PARTITIONS {name}").agg(F.count("*").cast("int").alias("partitions"))
    return s.sql(f"SELECT o_orderstatus, count(*) AS n FROM {name} GROUP BY 1").join(F.broadcast(found))  # one row


@query("sc11_partition_discovery", "SELECT o_orderkey FROM orders WHERE o_orderstatus='O'")
def sc11(s, d):
    p = new_path(s, "sc11")
    sinks.partitioned(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), p, "o_orderstatus")
    return s.read.option("pathGlobFilter", "*.parquet").parquet(p).where("o_orderstatus = 'O'").select("o_orderkey")


@query("sc11_incremental_discovery", """
SELECT 1 AS run, o_orderstatus AS status, count(*) AS n, count(*) AS priced FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 2
UNION ALL SELECT 2, o_orderstatus, count(*), 0 FROM orders WHERE o_orderstatus='P' GROUP BY 2""")
def sc11b(s, d):
    """Two crawls: the second reads only the folder that came since, which lacks a column that stays on record."""
    p, at = new_path(s, "sc11b"), new_path(s, "sc11b-manifest")
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"))
    out = None
    for run, (found, columns) in enumerate(((("F", "O"), ["o_orderkey", "o_totalprice", "status"]), (("P",), ["o_orderkey", "status"])), 1):
        sinks.partitioned(o.where(F.col("status").isin(*found)).select(*columns), p, "status", mode="append")
        rows = discovery.crawl(s, p, at).rows
        one = rows.groupBy("status").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("priced")).select(F.lit(run).alias("run"), "status", "n", "priced")
        out = one if out is None else out.unionByName(one)
    return out


@query("sc12_views", f"WITH {w.EDGES}, {w.SEEDS} SELECT count(*) AS n FROM edges WHERE src IN (SELECT node FROM seeds)")
def sc12(s, d):
    w.edges(s, d).createOrReplaceTempView("v_edges")
    w.seeds(s, d).createOrReplaceTempView("v_seeds")
    return s.sql("SELECT count(*) AS n FROM v_edges WHERE src IN (SELECT node FROM v_seeds)")


@query("sc13_json_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey%10<>0")
def sc13(s, d):
    p = new_path(s, "sc13")
    line = F.when(F.col("o_orderkey") % 10 == 0, F.lit('{"o_orderkey": nothing')).otherwise(F.to_json(F.struct("o_orderkey", "o_custkey")))
    table(s, d, "orders").select(line.alias("value")).write.text(p)
    return scans.json_rows(s, p, "o_orderkey long, o_custkey long")


@query("sc14_predictions_scan", f"WITH {w.SCORED} SELECT doc_id AS user_id, p AS probability, q AS shap, 1.0::DOUBLE AS feature FROM scored")
def sc14(s, d):
    wide = w.scored(s, d).select(F.col("doc_id").alias("user_id"), F.col("p").alias("probability"), F.col("q").alias("shap_ip"), F.lit("1.0").alias("kyc"))
    return scans.predictions(wide).select("user_id", "probability", F.col("contributions")["ip"].alias("shap"), F.col("features")["kyc"].alias("feature"))


@query("sc15_snapshot", "SELECT o_orderkey FROM orders WHERE o_orderpriority=(SELECT max(o_orderpriority) FROM orders) ORDER BY o_orderkey LIMIT 40")
def sc15(s, d):
    return scans.snapshot(table(s, d, "orders"), "o_orderpriority", "o_orderkey", 40).select("o_orderkey")


@query("sc16_key_lookup", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey=7")
def sc16(s, d):
    return scans.by_key(table(s, d, "customer"), "c_custkey", 7, ["c_custkey", "c_acctbal"])


@query("sc17_batched_lookup", "SELECT CAST(a.pos AS INT) AS pos, a.c_custkey, c_acctbal FROM (VALUES (0,9),(1,3),(2,-1),(3,5)) a(pos,c_custkey) LEFT JOIN customer USING(c_custkey)")
def sc17(s, d):
    return scans.by_keys(table(s, d, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_acctbal"), "c_custkey", [9, 3, -1, 5])


@query("sc18_in_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1,5,10)")
def sc18(s, d):
    return table(s, d, "customer").where(F.col("c_custkey").isin(1, 5, 10)).select("c_custkey", "c_name")


@query("sc19_tolerant_load", "SELECT 'orders' AS name, count(*) AS n FROM orders")
def sc19(s, d):
    found = scans.load_all(s, d, ["orders", "no_such_table"])
    return found["orders"].agg(F.count("*").alias("n")).select(F.lit(",".join(sorted(found))).alias("name"), "n")


@query("sc20_secondary_index", f"WITH {w.SCORED} SELECT doc_id, p FROM scored WHERE p>0.9")
def sc20(s, d):
    tiers = w.scored(s, d).withColumn("tier", risk.tier(F.col("p")))
    return scans.by_key(tiers, "tier", "EXTREME", ["doc_id", "p"]).orderBy(F.desc("p"), "doc_id")


@query("sk1_partitioned_parquet", "SELECT o_orderkey, o_orderpriority FROM orders")
def sk1(s, d):
    p = new_path(s, "sk1")
    sinks.partitioned(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), p, "o_orderpriority")
    return s.read.parquet(p)


@query("sk2_create_table_as", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def sk2(s, d):
    p = new_path(s, "sk2")
    table(s, d, "orders").createOrReplaceTempView("t_orders")
    name = sinks.create_table_as(s, f"t_orders_by_customer_{p[-32:]}", p, "SELECT o_custkey, count(*) AS n FROM t_orders GROUP BY 1")
    return s.table(name)


@query("sk3_bounded_parts", "SELECT count(*) AS n, true AS bounded FROM orders")
def sk3(s, d):
    p = new_path(s, "sk3")
    sinks.bounded_parts(table(s, d, "orders").select("o_orderkey"), p, 1000)
    per = s.read.parquet(p).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), (F.max("n") <= 1000).alias("bounded"))


@query("sk5_dual_format", ORDERS)
def sk5(s, d):
    p = new_path(s, "sk5")
    sinks.dual(_orders(s, d), p)
    return s.read.parquet(f"{p}/parquet")


@query("sk6_training_csv", "SELECT toxic AS _c0, quality AS _c1 FROM labels")
def sk6(s, d):
    p = new_path(s, "sk6")
    sinks.training_csv(table(s, d, "labels"), p, "toxic", ["quality"])
    return s.read.schema("_c0 int, _c1 int").csv(p)


def _put(row):
    if int(row["c_custkey"]) % 100 == 0:
        raise ValueError("refused")


@query("sk7_keyed_puts", "SELECT true AS ok, count(*) FILTER (c_custkey%100<>0) AS n FROM customer UNION ALL SELECT false, count(*) FILTER (c_custkey%100=0) FROM customer")
def sk7(s, d):
    from talus.plans import storage

    return sinks.put_rows(table(s, d, "customer").select("c_custkey", "c_acctbal"), storage._put).withColumn("n", F.col("n").cast("long"))


@query("sk9_value_encoding", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, printf('%.8f',c_acctbal) AS c_acctbal, CASE WHEN c_acctbal>0 THEN '1' ELSE '0' END AS ok FROM customer")
def sk9(s, d):
    return clean.encode_values(table(s, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") > 0).alias("ok")))


@query("sk11_submission_csv", f"WITH {w.SCORED} SELECT doc_id AS user_id, CAST(p>=0.24 AS INT) AS status FROM scored")
def sk11(s, d):
    p = new_path(s, "sk11")
    sinks.submission(w.scored(s, d).select(F.col("doc_id").alias("user_id"), (F.col("p") >= 0.24).cast("int").alias("status")), p)
    return s.read.schema("user_id long, status int").option("header", True).csv(p)


@query("sk12_action_queue", f"WITH {w.SCORED} SELECT doc_id AS user_id FROM scored WHERE NOT (p>=0.65 AND p<=0.9)")
def sk12(s, d):
    p = new_path(s, "sk12")
    acted = risk.with_actions(w.scored(s, d).select(F.col("doc_id").alias("user_id"), risk.tier(F.col("p")).alias("tier")))
    sinks.action_queue(acted, p)
    return s.read.schema("user_id long").json(p)


@query("sk4_sink_fallback", "SELECT o_orderkey FROM orders")
def sk4(s, d):
    p = new_path(s, "sk4")
    at = sinks.with_fallback(table(s, d, "orders").select("o_orderkey"), "nosuchscheme://nowhere/x", p)
    return s.read.schema("o_orderkey long").option("header", True).csv(at)


@query("sk8_put_counts", "SELECT count(*) FILTER (c_custkey%100<>0) AS success, count(*) FILTER (c_custkey%100=0) AS failed FROM customer")
def sk8(s, d):
    from talus.plans import storage

    n = sinks.put_rows(table(s, d, "customer").select("c_custkey"), storage._put)
    return n.agg(F.sum(F.when(F.col("ok"), F.col("n"))).alias("success"), F.sum(F.when(~F.col("ok"), F.col("n"))).alias("failed"))


@query("sk10_keyed_batch_write", f"WITH {w.SCORED} SELECT doc_id AS user_id, CASE WHEN p>=0.75 THEN 'HIGH' WHEN p>=0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM scored")
def sk10(s, d):
    from talus.streaming import pipelines as st

    rows = w.scored(s, d).select(F.col("doc_id").alias("user_id"), risk.coarse_level(F.col("p")).alias("risk_level"))
    p = new_path(s, "sk10")
    rows.repartition(3).write.parquet(p)
    return st.upsert_latest(st.file_stream(s, p, rows.schema), "user_id", "risk_level")


@query("sk13_state_table", "SELECT 'load' AS stage, count(*)||' orders' AS detail FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey)||' customers' FROM orders")
def sk13(s, d):
    """Stages record what they did; a stage that ran again is one stage."""
    p = new_path(s, "sk13")
    o = table(s, d, "orders")
    for name, done in (("load", F.concat(F.count("*"), F.lit(" orders"))), ("customers", F.concat(F.count_distinct("o_custkey"), F.lit(" customers"))), ("load", F.concat(F.count("*"), F.lit(" orders")))):
        sinks.mark_done(s, p, name, o.agg(done).first()[0])
    return sinks.done_stages(s, p)


@query("sk7_keyed_data_source", "SELECT c_custkey, round(c_acctbal+CASE WHEN c_custkey%2=0 THEN 1 ELSE 0 END,2) AS c_acctbal FROM customer")
def sk7b(s, d):
    """Two writes through the data source: keys of the second replace those of the first."""
    s.dataSource.register(keyed.KeyedSink)
    p = new_path(s, "sk7b")
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    for rows in (c, c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)):
        rows.write.format("talus_keyed").mode("append").option("path", p).option("key", "c_custkey").save()
    return keyed.read_keyed(s, p, "c_custkey", c.schema).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("sk8_keyed_stream", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def sk8b(s, d):
    """A stream into the keyed store, each batch committed once: the last order of each customer."""
    from talus.streaming import pipelines as st

    s.dataSource.register(keyed.KeyedSink)
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    src, out, at = (new_path(s, f"sk8b-{x}") for x in ("in", "out", "checkpoint"))
    top = o.agg(F.max("o_orderkey")).first()[0]
    for k in range(3):  # files in the order of the keys
        o.where((F.col("o_orderkey") * 3 > k * top) & (F.col("o_orderkey") * 3 <= (k + 1) * top) if k else F.col("o_orderkey") * 3 <= top).coalesce(1).write.mode("append").parquet(src)
    st.file_stream(s, src, o.schema).writeStream.format("talus_keyed").option("path", out).option("key", "o_custkey").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return keyed.read_keyed(s, out, "o_custkey", o.schema, "o_orderkey")

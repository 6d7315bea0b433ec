"""Text, privacy and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import text
from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import table

# written apart from the engine's patterns, for an engine without look-behind
REDACTED = r"""
WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS n_ip, regexp_replace(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[IP-REDACTED]', 'g') AS t FROM documents),
b AS (SELECT * EXCLUDE t, len(regexp_extract_all(t, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) AS n_email, regexp_replace(t, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[EMAIL-REDACTED]', 'g') AS t FROM a),
c AS (SELECT * EXCLUDE t, len(regexp_extract_all(t, '\b09[0-9]{8}\b')) AS n_mobile, regexp_replace(t, '\b09[0-9]{8}\b', '[PHONE-REDACTED]', 'g') AS t FROM b),
d AS (SELECT * EXCLUDE t, len(regexp_extract_all(t, '\+[0-9]{8,15}\b')) AS n_phone, regexp_replace(t, '\+[0-9]{8,15}\b', '[PHONE-REDACTED]', 'g') AS t FROM c)
SELECT doc_id, md5(regexp_replace(t, '\b[A-Z][12][0-9]{8}\b', '[ID-REDACTED]', 'g')) AS redacted, n_ip, n_email, n_mobile, n_phone, len(regexp_extract_all(t, '\b[A-Z][12][0-9]{8}\b')) AS n_national_id FROM d"""


@query("x1_redaction", REDACTED)
def x1(s, d):
    out = text.redacted(table(s, d, "documents").select("doc_id", "text"), "text")
    counts = [F.col(f"n_{name}").cast("long").alias(f"n_{name}") for name, _, _ in text.MASKS]
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("redacted"), *counts)


@query("x2_context_filter", "SELECT c_custkey, 'kyc_level,hop_risk_level' AS kept FROM customer WHERE c_custkey%2=0 UNION ALL SELECT c_custkey, 'kyc_level' FROM customer WHERE c_custkey%2=1")
def x2(s, d):
    c = table(s, d, "customer")
    level = F.when(F.col("c_custkey") % 2 == 0, "direct").otherwise("secret place")
    m = F.create_map(F.lit("kyc_level"), F.lit("1"), F.lit("full_name"), F.col("c_name"), F.lit("wallet_address"), F.lit("0x1"), F.lit("hop_risk_level"), level)
    return c.select("c_custkey", F.array_join(F.map_keys(text.allowed_context(m)), ",").alias("kept"))


@query("x3_feature_filter", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ip_anomaly,kyc_level' WHEN 1 THEN 'kyc_level' ELSE '' END AS kept, round(CASE c_custkey % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE c_acctbal + 1 END, 2) AS total
FROM customer""")
def x3(s, d):
    pair = lambda n, v: F.struct(n.alias("feature"), v.cast("double").alias("value"))
    m = F.pmod("c_custkey", F.lit(3))
    one = pair(F.when(m == 0, "ip_anomaly").otherwise("source_ip_raw"), F.col("c_acctbal"))
    two = pair(F.when(m == 2, "user_email_hash").otherwise("kyc_level"), F.lit(1.0))
    kept = text.allowed_features(F.array(one, pair(F.lit("full_name"), F.lit(5.0)), two))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["value"])
    return table(s, d, "customer").select("c_custkey", F.array_join(F.transform(kept, lambda x: x["feature"]), ",").alias("kept"), F.round(total, 2).alias("total"))


@query("x4_span_redaction", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '[REDACTED]' || substr(c_name, 9) ELSE substr(c_name, 1, 2) || '[REDACTED]' || substr(c_name, 6, 3) || '[REDACTED]' || substr(c_name, 13) END AS redacted
FROM customer""")
def x4(s, d):
    span = lambda a, b: F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end"))
    m = F.pmod("c_custkey", F.lit(3))
    spans = F.when(m == 1, F.array(span(0, 8))).when(m == 2, F.array(span(2, 5), span(8, 12)))
    return table(s, d, "customer").select("c_custkey", text.redact_spans(F.col("c_name"), spans).alias("redacted"))


#: Source lines made of the customers, of which some break each rule, as SQL; the documents' lines are scanned as they are.
CODE_LINES = """
SELECT c_custkey AS doc_id, CASE c_custkey % 8
  WHEN 0 THEN 'token = "' || substr(sha256(c_name), 1, 20) || '"'
  WHEN 1 THEN 'password = "your-' || substr(sha256(c_name), 1, 20) || '"'
  WHEN 2 THEN 'aws_secret_access_key = "' || substr(sha256(c_name), 1, 40) || '"'
  WHEN 3 THEN 'key: AKIA' || upper(substr(sha256(c_name), 1, 16)) || ' end'
  WHEN 4 THEN '# token = "' || substr(sha256(c_name), 1, 20) || '"'
  WHEN 5 THEN 'api_key = "' || substr(sha256(c_name), 1, 20) || '"  # example'
  WHEN 6 THEN 'aws_access_key_id = "' || substr(sha256(c_name), 1, 20) || '"'
  ELSE 'client.put(acl="x"); xAKIA_' || c_name END AS line
FROM customer"""


@query("x5_credential_scan", f"""
WITH l AS (SELECT 'document' AS kind, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT 'code', * FROM ({CODE_LINES})),
c AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^\\s*#')),
g AS (SELECT *, list_filter(regexp_extract_all(line, '(?i)(?:token|password|passwd|secret|api_key|apikey|private_key)\\s*=\\s*["'']([^"'']{{16,}})["'']', 1),
  lambda v: NOT regexp_matches(v, '(?i)^(your|example|test|dummy|placeholder|change|replace|TODO|ACCOUNT_ID|REGION|xxx|<[^>]+>)')) AS secrets FROM c),
r AS (
  SELECT kind, doc_id, line, 'generic_secret' AS rule FROM g WHERE len(secrets) > 0
  UNION ALL SELECT kind, doc_id, line, 'access_key' FROM c WHERE regexp_matches(line, '(^|[^A-Z0-9_])(AKIA|ASIA)[0-9A-Z]{{16}}([^A-Z0-9_]|$)')
  UNION ALL SELECT kind, doc_id, line, 'secret_key' FROM c WHERE regexp_matches(line, '(?i)(aws_secret_access_key|secret_access_key|SecretAccessKey)\\s*[=:]\\s*["''][A-Za-z0-9/+]{{40}}["'']')
  UNION ALL SELECT kind, doc_id, line, 'inline_credential' FROM c WHERE regexp_matches(line, '(?i)(aws_access_key_id|aws_secret_access_key)\\s*=\\s*["''][A-Za-z0-9/+=]{{16,}}["'']'))
SELECT kind, doc_id, rule, CASE WHEN regexp_matches(line, '(?i)ACCOUNT_ID|your[-_]?(bucket|key|token|role)|placeholder|change[-_]?me|example|TODO|xxx|<FILL|REPLACE_ME') THEN 'WARN' ELSE 'FAIL' END AS severity, count(*) AS n
FROM r GROUP BY ALL""")
def x5(s, d):
    h, name = F.sha2("c_name", 256), F.col("c_name")
    part = lambda head, n, tail: F.concat(F.lit(head), F.substring(h, 1, n), F.lit(tail))
    m = F.pmod("c_custkey", F.lit(8))
    line = F.when(m == 0, part('token = "', 20, '"')).when(m == 1, part('password = "your-', 20, '"')).when(m == 2, part('aws_secret_access_key = "', 40, '"'))
    line = line.when(m == 3, F.concat(F.lit("key: AKIA"), F.upper(F.substring(h, 1, 16)), F.lit(" end"))).when(m == 4, part('# token = "', 20, '"'))
    line = line.when(m == 5, part('api_key = "', 20, '"  # example')).when(m == 6, part('aws_access_key_id = "', 20, '"')).otherwise(F.concat(F.lit('client.put(acl="x"); xAKIA_'), name))
    code = table(s, d, "customer").select(F.lit("code").alias("kind"), F.col("c_custkey").alias("doc_id"), line.alias("line"))
    lines = text.lines_of(table(s, d, "documents")).select(F.lit("document").alias("kind"), "doc_id", "line")
    return text.scan_lines(lines.unionByName(code)).groupBy("kind", "doc_id", "rule", "severity").agg(F.count("*").alias("n"))


@query("x6_access_scan", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS m, c_custkey % 5 AS k FROM customer)
SELECT 'code' AS kind, id, 'public_acl' AS rule, 'FAIL' AS severity FROM c WHERE m IN (0, 1)
UNION ALL SELECT 'template', id, CASE m WHEN 1 THEN 'block_missing' WHEN 2 THEN 'block_off' ELSE 'block_ok' END, CASE WHEN m IN (1, 2) THEN 'FAIL' ELSE 'INFO' END FROM c WHERE m < 4
UNION ALL SELECT 'bucket', id, CASE k WHEN 0 THEN 'no_block' WHEN 1 THEN 'block_off' ELSE 'block_ok' END, CASE WHEN k < 2 THEN 'FAIL' ELSE 'INFO' END FROM c
UNION ALL SELECT 'bucket', id, 'open_grant', 'FAIL' FROM c WHERE k IN (1, 3)
UNION ALL SELECT 'bucket', id, 'any_principal', 'FAIL' FROM c WHERE k IN (2, 3)""")
def x6(s, d):
    """Source lines, storage templates and buckets' settings made of the customers."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.pmod("c_custkey", F.lit(6)).alias("m"), F.pmod("c_custkey", F.lit(5)).alias("k"))
    m, k = F.col("m"), F.col("k")
    line = F.when(m == 0, "s3.put(CannedACL='public-read')").when(m == 1, '  {"acl": "public-read-write"}').when(m == 2, "# CannedACL = 'public-read'").otherwise("acl: private, public-read")
    code = text.scan_lines(c.select("id", line.alias("line")), (("public_acl", text.PUBLIC_ACL),)).select(F.lit("code").alias("kind"), "id", "rule", F.lit("FAIL").alias("severity"))
    bucket = "Type: AWS::S3::Bucket\n"
    block = lambda v: bucket + "PublicAccessBlockConfiguration:\n" + "".join(f"  {n}: {v if n == 'BlockPublicPolicy' else 'true'}\n" for n in text.BLOCK_SETTINGS)
    body = F.when(m == 0, block("true")).when(m == 1, block("true") + bucket).when(m == 2, block("False")).when(m == 3, block("true") * 2).otherwise("Type: AWS::SQS::Queue")
    templates = text.template_findings(c.select("id", body.alias("text")), "id").select(F.lit("template").alias("kind"), "id", "rule", "severity")
    on = lambda last: F.create_map(*[x for n in text.BLOCK_SETTINGS for x in (F.lit(n), last if n == text.BLOCK_SETTINGS[-1] else F.lit(True))])
    grants = F.array(F.struct(F.when(k.isin(1, 3), "http://acs.example/groups/AllUsers").otherwise("owner").alias("uri"), F.lit("READ").alias("permission")))
    policy = F.array(F.struct(F.when(k == 4, "Deny").otherwise("Allow").alias("effect"), F.when(k.isin(2, 3, 4), "*").otherwise("somebody").alias("principal")))
    config = F.to_json(F.struct(F.when(k > 0, on(k != 1)).alias("settings"), grants.alias("grants"), policy.alias("policy")))
    buckets = text.bucket_findings(c.select("id", config.alias("config")), "id").select(F.lit("bucket").alias("kind"), "id", "rule", "severity")
    return code.unionByName(templates).unionByName(buckets)


@query("x7_narrative", f"WITH {w.SCORED} SELECT doc_id, CASE WHEN p>0.5 THEN 'funds stayed only ' ELSE 'funds stayed ' END||printf('%.2f',q*100)||' minutes' AS sentence FROM scored")
def x7(s, d):
    return w.scored(s, d).select("doc_id", text.narrative(F.lit("min_retention_minutes"), F.col("p") - 0.5, F.col("q") * 100).alias("sentence"))


@query("x8_output_parsing", "SELECT doc_id, CASE doc_id%3 WHEN 0 THEN CAST(doc_id AS INT) WHEN 1 THEN CAST(doc_id AS INT) ELSE -1 END AS v FROM labels")
def x8(s, d):
    body = F.concat(F.lit('{"v": '), F.col("doc_id").cast("string"), F.lit("}"))
    raw = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise("no answer")
    return table(s, d, "labels").select("doc_id", text.parsed(raw, "v int", F.struct(F.lit(-1).alias("v")))["v"].alias("v"))


@query("fn1_strings", "SELECT c_custkey, length(c_name) AS n, lower(trim(c_mktsegment)) AS low, substr(c_name,1,4) AS head, replace(c_name,'#','-') AS swapped, lpad(CAST(c_custkey AS VARCHAR),8,'0') AS padded, contains(c_mktsegment,'A') AS has_a FROM customer")
def fn1(s, d):
    return table(s, d, "customer").select("c_custkey", F.length("c_name").cast("long").alias("n"), F.lower(F.trim("c_mktsegment")).alias("low"), F.substring("c_name", 1, 4).alias("head"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("swapped"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.contains("c_mktsegment", F.lit("A")).alias("has_a"))


@query("fn2_hashes", "SELECT c_custkey, sha256(c_name) AS sha FROM customer")
def fn2(s, d):
    return table(s, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha"))


@query("fn3_datetimes", "SELECT event_id, CAST(hour(ts) AS INT) AS h, date_trunc('hour',ts) AS hour_start, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts,'%Y-%m-%d') AS day, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS since FROM events")
def fn3(s, d):
    ts = F.col("ts")
    return table(s, d, "events").select("event_id", F.hour(ts).alias("h"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start"), F.unix_timestamp(ts.cast("timestamp")).alias("seconds"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', date_trunc('second', ts))").alias("since"))


@query("fn4_math", "SELECT c_custkey, round(abs(c_acctbal),1) AS a, ceil(c_acctbal)::BIGINT AS c, round(1/(1+exp(-c_acctbal/10000)),6) AS s, round(sqrt(abs(c_acctbal)),6) AS q, least(c_acctbal,0.0)::DOUBLE AS lo, greatest(c_acctbal,0.0)::DOUBLE AS hi FROM customer")
def fn4(s, d):
    b = F.col("c_acctbal")
    return table(s, d, "customer").select("c_custkey", F.round(F.abs(b), 1).alias("a"), F.ceil(b).alias("c"), F.round(1 / (1 + F.exp(-b / 10000)), 6).alias("s"), F.round(F.sqrt(F.abs(b)), 6).alias("q"), F.least(b, F.lit(0.0)).alias("lo"), F.greatest(b, F.lit(0.0)).alias("hi"))


@query("fn5_arrays", f"WITH {w.EV}, m AS (SELECT DISTINCT source_ip, user_id FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY user_id) AS n FROM m) SELECT source_ip, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY user_id) AS head FROM r WHERE n<=5 GROUP BY 1")
def fn5(s, d):
    ids = F.slice(F.sort_array(F.collect_set("user_id")), 1, 5)
    return w.events(s, d).groupBy("source_ip").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), "|").alias("head"))


@query("fn6_maps", "SELECT c_custkey, 'a' AS keys, c_acctbal AS a FROM customer")
def fn6(s, d):
    m = F.create_map(F.lit("shap_a"), F.col("c_acctbal"), F.lit("other"), F.lit(0.0))
    picked = F.transform_keys(F.map_filter(m, lambda k, v: k.startswith("shap_")), lambda k, v: F.replace(k, F.lit("shap_"), F.lit("")))
    return table(s, d, "customer").select("c_custkey", F.array_join(F.map_keys(picked), ",").alias("keys"), picked["a"].alias("a"))


@query("fn7_json", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events")
def fn7(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("fn8_try_cast", "SELECT c_custkey, TRY_CAST(replace(c_name,'Customer#','') AS BIGINT) AS n, TRY_CAST(c_mktsegment AS DOUBLE) AS x FROM customer")
def fn8(s, d):
    return table(s, d, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer#"), F.lit("")).try_cast("bigint").alias("n"), F.col("c_mktsegment").try_cast("double").alias("x"))

"""Queries of data quality."""

from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators import quality as Q
from .registry import Tables, query


@query("SELECT fact_key, fact_no % 10 <> 0 AND fact_no % 7 <> 0 AS valid, count(*) AS n FROM facts GROUP BY ALL")
def q1_validate_observations(t: Tables):
    oid = F.when(F.col("fact_no") % 10 == 0, "broken").otherwise(content_id("observation:", F.col("entity_id"), F.col("fact_key"), F.col("value_text")))
    rows = t.facts.withColumn("observation_id", oid).withColumn("subject", F.when(F.col("fact_no") % 7 == 0, "other").otherwise(F.col("entity_id")))
    return Q.validate_observations(rows, "observation:", ["entity_id", "fact_key", "value_text"]).groupBy("fact_key", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linenumber, l_suppkey < l_partkey AND l_discount * 12 <= 1 AS valid, count(*) AS n FROM lineitem GROUP BY ALL")
def q2_validate_derivations(t: Tables):
    rows = t.lineitem.select("l_linenumber", F.array("l_suppkey", "l_partkey").alias("inputs"), F.col("l_quantity").alias("value"), (F.col("l_discount") * 12).alias("confidence"))
    return Q.validate_derivations(rows).groupBy("l_linenumber", "valid").agg(F.count(F.lit(1)).alias("n"))


_REASONS = "x AS (SELECT entity_id, max(CASE WHEN value_text = '5-LOW' THEN 1 ELSE 0 END) AS l, max(CASE WHEN value_text = 'F' THEN 1 ELSE 0 END) AS f, max(confidence) AS b FROM facts GROUP BY 1), r AS (SELECT entity_id, concat_ws('+', CASE WHEN coalesce(l, 0) = 0 THEN 'no low' END, CASE WHEN coalesce(f, 0) = 0 THEN 'no closed' END, CASE WHEN coalesce(b, 0) < 0.9 THEN 'weak evidence' END) AS reasons FROM entities LEFT JOIN x USING (entity_id) WHERE entity_type = 'customer')"


def _quarantine(t: Tables):
    keyed = t.facts.withColumn("fact_key", F.when(F.col("value_text") == "5-LOW", "low").when(F.col("value_text") == "F", "closed").otherwise("x"))
    return Q.quarantine(t.entities.filter("entity_type = 'customer'"), keyed, t.edges, ["low", "closed"], 0.9)


@query(f"WITH {_REASONS} SELECT entity_id, reasons FROM r WHERE reasons <> ''")
def q3_quarantine(t: Tables):
    return _quarantine(t)[0].select("entity_id", F.array_join("reasons", "+").alias("reasons"))


@query(f"WITH {_REASONS} SELECT edge_type, count(*) AS n FROM edges WHERE src NOT IN (SELECT entity_id FROM r WHERE reasons <> '') AND dst NOT IN (SELECT entity_id FROM r WHERE reasons <> '') GROUP BY 1")
def q3_surviving_edges(t: Tables):
    return _quarantine(t)[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'one parent' AS rule, entity_id AS id FROM entities LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM edges WHERE edge_type = 'supplied_by' GROUP BY 1) ON src = entity_id WHERE entity_type = 'part' AND coalesce(n, 0) <> 1 UNION ALL SELECT 'repeated id', entity_id FROM entities WHERE entity_type = 'region'")
def q4_check_rules(t: Tables):
    return Q.check_rules(t.entities.unionByName(t.entities.filter("entity_type = 'region'")), t.edges, "supplied_by", ["part"])


@query("SELECT fact_key, 'no metadata' AS side FROM facts WHERE fact_key = 'order_total' GROUP BY 1 UNION ALL SELECT 'order_owner', 'no facts'")
def q4_keys_differ(t: Tables):
    return Q.keys_differ(t.facts, t.spark.createDataFrame([("order_status",), ("order_priority",), ("order_owner",)], "fact_key string"))


@query("SELECT p AS preference, CASE WHEN n = 0 THEN 'no facts' WHEN best < 0.97 THEN 'weak' ELSE 'supported' END AS state FROM (SELECT 'urgent' AS p, count(*) AS n, max(confidence) AS best FROM facts WHERE fact_key = 'order_priority' UNION ALL SELECT 'owner', 0, NULL)")
def q5_capabilities(t: Tables):
    return Q.capabilities(t.facts, t.spark.createDataFrame([("urgent", "order_priority"), ("owner", "order_owner")], "preference string, fact_key string"), 0.97)


@query("""WITH w AS (SELECT entity_id, k AS fact_key FROM entities, (VALUES ('order_total'), ('order_owner')) AS v(k) WHERE entity_type IN ('customer', 'nation')) SELECT entity_id, fact_key FROM w WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = w.entity_id AND f.fact_key = w.fact_key AND confidence >= 0.95)""")
def q6_mine_gaps(t: Tables):
    wanted = t.entities.filter("entity_type IN ('customer', 'nation')").select("entity_id", F.explode(F.array(F.lit("order_total"), F.lit("order_owner"))).alias("fact_key"))
    return Q.mine_gaps(wanted, t.facts, t.edges, 0.95)


@query("SELECT c_custkey AS case_id, CASE WHEN c_custkey % 4 = 1 OR concat('customer:', c_custkey) NOT IN (SELECT entity_id FROM facts) THEN 'absent' WHEN c_custkey % 4 = 2 THEN 'without metadata' ELSE 'present' END AS state FROM customer")
def q7_audit_failures(t: Tables):
    k = F.col("c_custkey")
    cases = t.customer.select(k.alias("case_id"), F.concat(F.lit("customer:"), k).alias("entity_id"), F.when(k % 4 == 1, "order_owner").when(k % 4 == 2, "order_status").otherwise("order_total").alias("fact_key"))
    return Q.audit_failures(cases, t.facts, t.spark.createDataFrame([("order_total",)], "fact_key string"))


@query("SELECT k AS fact_no, CASE WHEN k % 5 = 0 THEN concat('https://old.example/', k) ELSE concat('https://img.example/', k) END AS url, CASE WHEN k % 5 = 0 THEN 'retired' WHEN k % 3 = 0 THEN 'missing' ELSE 'hash differs' END AS state FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 5 = 0 OR k % 3 = 0 OR k % 7 = 0")
def q8_check_media(t: Tables):
    k = F.col("o_orderkey")
    url = F.when(k % 5 == 0, F.concat(F.lit("https://old.example/"), k)).otherwise(F.concat(F.lit("https://img.example/"), k))
    facts = t.orders.select(k.alias("fact_no"), F.concat(F.lit("see ("), url, F.lit(") and more")).alias("text"), F.lit("h").alias("sha"))
    files = t.orders.filter("o_orderkey % 3 <> 0").select(url.alias("url"), F.when(k % 7 == 0, "other").otherwise("h").alias("sha"))
    return Q.check_media(facts, files, "https://old.example/")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'range' WHEN 1 THEN 'open' WHEN 2 THEN 'points' WHEN 3 THEN 'distance' ELSE 'ok' END AS state FROM nation")
def q9_validate_geometry(t: Tables):
    k = F.col("n_nationkey") % 5
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, one = F.lit(0), F.lit(1)
    ring = F.array(p(F.when(k == 0, 999).otherwise(0), zero), p(one, zero), F.when(k == 2, p(zero, zero)).otherwise(p(one, one)), p(F.when(k == 0, 999).when(k == 1, 5).otherwise(0), zero))
    return Q.validate_geometry(t.nation.select(F.col("n_nationkey").alias("id"), ring.alias("ring"), F.lit(100.0).alias("measured_m"), F.when(k == 3, 200.0).otherwise(110.0).alias("stated_m")))


@query("SELECT l_returnflag, CASE WHEN l_linenumber = 1 OR l_discount * 12 > 1 OR l_quantity < 2 THEN 'rejected' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'accepted' ELSE 'quarantined' END AS state, count(*) AS n FROM lineitem GROUP BY ALL")
def q10_validate_claims(t: Tables):
    claims = t.lineitem.select("l_returnflag", F.when(F.col("l_linenumber") == 1, " ").otherwise("s").alias("subject"), F.lit("p").alias("predicate"), (F.col("l_discount") * 12).alias("confidence"), F.when(F.col("l_quantity") < 2, 0).otherwise(3).alias("page"), F.lit("q").alias("quote"), F.col("l_returnflag").alias("source"), (F.col("l_linestatus") == "F").alias("exact"))
    return Q.validate_claims(claims, ["N"]).groupBy("l_returnflag", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS asset, CAST(DATE '2002-01-01' - d AS BIGINT) AS age_days, CASE o_orderstatus WHEN 'F' THEN DATE '2002-01-01' - d > 1000 WHEN 'O' THEN DATE '2002-01-01' - d > 2000 END AS stale FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)")
def q11_freshness(t: Tables):
    day = F.to_date("o_orderdate")
    marks = F.when(F.col("o_orderkey") % 2 == 0, F.array(day.cast("string"), F.date_add(day, 40).cast("string"), F.lit("soon"))).otherwise(F.array(F.lit("unknown")))
    rows = t.orders.select(F.col("o_orderkey").alias("asset"), F.col("o_orderstatus").alias("cadence"), marks.alias("watermarks"), day.alias("created"))
    return Q.freshness(rows, F.lit("2002-01-01").cast("date"), {"F": 1000, "O": 2000}).withColumn("age_days", F.col("age_days").cast("long"))


@query("SELECT src, dst, least(confidence, 0.7) AS confidence FROM edges WHERE regexp_matches(dst, '^supplier:[0-9]+$') AND edge_type = 'supplied_by' AND least(confidence, 0.7) >= 0.3")
def q12_admit(t: Tables):
    return Q.admit(t.edges.withColumnRenamed("edge_type", "source_type"), "^supplier:[0-9]+$", ["supplied_by"], 0.7, 0.3).select("src", "dst", "confidence")


@query("WITH b AS (SELECT l_returnflag AS metric, count(*) AS v FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag AS metric, count(*) AS v FROM lineitem WHERE l_linenumber <= 5 AND l_returnflag <> 'A' GROUP BY 1) SELECT metric, b.v AS baseline, coalesce(c.v, 0) AS candidate, coalesce(c.v, 0) >= floor(b.v * 0.85::DOUBLE) AS passed FROM b LEFT JOIN c USING (metric)")
def q13_ratio_check(t: Tables):
    count = lambda df: df.groupBy(F.col("l_returnflag").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return Q.ratio_check(count(t.lineitem), count(t.lineitem.filter("l_linenumber <= 5 AND l_returnflag <> 'A'")))


@query("SELECT o_orderkey AS unit, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'timeout' WHEN '2' THEN 'missing' ELSE 'unknown' END AS code, o_orderpriority LIKE '1%' AS retryable, concat('failure:', sha256(concat_ws(chr(31), o_orderkey, o_orderpriority))) AS failure_id FROM orders")
def q14_failure_ledger(t: Tables):
    return Q.failure_ledger(t.orders.select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("message")), [("1", "timeout", True), ("2", "missing", False)])

"""Data-quality and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..streaming import logs
from .ledger import read
from .registry import query


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type AS target_type, count(*)::BIGINT AS total, count(*) FILTER (WHERE value > 50)::BIGINT AS open FROM events GROUP BY 1")
def flag_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("target_type"), F.when(F.col("value") > 50, "open").otherwise("closed").alias("status"))
    return Q.flag_summary(e)


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def activity_tail(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "event_type", "user_id")


@query("""SELECT 'orders' AS dataset, * FROM (
SELECT 'o_totalprice' AS "column", 'in_range(1000, 400000)' AS "check", o_totalprice::VARCHAR AS failure_case FROM orders WHERE o_totalprice IS NOT NULL AND NOT o_totalprice BETWEEN 1000 AND 400000
UNION ALL SELECT 'o_orderstatus', 'isin', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'o_orderpriority', 'matches(^[1-4]-)', o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
UNION ALL SELECT 'o_orderpriority', 'min_length(6)', o_orderpriority FROM orders WHERE length(o_orderpriority) < 6)""")
def quality_gate(spark, sf_dir):
    rules = [Q.in_range("o_totalprice", 1000, 400000), Q.one_of("o_orderstatus", ["F", "O"]), Q.matches("o_orderpriority", "^[1-4]-"), Q.min_length("o_orderpriority", 6), Q.required("o_custkey")]
    return Q.failures(read(spark, sf_dir, "orders"), "orders", rules)


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_refs(spark, sf_dir):
    return Q.dangling(read(spark, sf_dir, "documents").select("doc_id"), None, read(spark, sf_dir, "labels"), "doc_id")


METRICS = "m AS (SELECT 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'finished', count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE FROM orders UNION ALL SELECT 'large', count(*) FILTER (WHERE o_totalprice > 400000)::DOUBLE FROM orders UNION ALL SELECT 'finished_pct', round_even(100 * count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1), 1) FROM orders)"


def _metrics(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return Q.metrics(read(spark, sf_dir, "orders"), {"orders": F.count(F.lit(1)), "finished": done, "large": F.count_if(F.col("o_totalprice") > 400000), "finished_pct": Q.share(done, F.count(F.lit(1)))})


@query(f"WITH {METRICS} SELECT metric, value FROM m")
def health_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(f"WITH {METRICS} SELECT metric, value, CASE metric WHEN 'orders' THEN CASE WHEN value >= 100 THEN 'OK' ELSE 'FAIL' END WHEN 'large' THEN CASE WHEN value = 0 THEN 'OK' ELSE 'FAIL' END ELSE CASE WHEN value >= 90 THEN 'OK' ELSE 'WARN' END END AS status FROM m WHERE metric IN ('orders', 'large', 'finished_pct')")
def health_checks(spark, sf_dir):
    return Q.verdicts(_metrics(spark, sf_dir), {"orders": (">=", 100, "FAIL"), "large": ("=", 0, "FAIL"), "finished_pct": (">=", 90, "WARN")})


@query(f"WITH {METRICS}, b AS (SELECT metric, CASE metric WHEN 'orders' THEN value * 1.2 WHEN 'finished' THEN value * 1.05 ELSE 0 END AS previous FROM m WHERE metric <> 'finished_pct') SELECT metric, value, previous, CASE WHEN value < previous THEN 'WARN' ELSE 'OK' END AS status FROM m LEFT JOIN b USING (metric) WHERE previous IS NULL OR (previous <> 0 AND abs(value - previous) / greatest(1, previous) >= 0.1)")
def drift(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    before = m.filter("metric != 'finished_pct'").select("metric", F.when(F.col("metric") == "orders", F.col("value") * 1.2).when(F.col("metric") == "finished", F.col("value") * 1.05).otherwise(0.0).alias("value"))
    return Q.drift(m, before)


@query("SELECT lang, count(*)::BIGINT AS docs, count(l.doc_id)::BIGINT AS labelled, round_even(100 * count(l.doc_id) / greatest(count(*), 1), 1) AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def coverage(spark, sf_dir):
    d, n = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    return d.join(n, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count("has").alias("labelled"), Q.share(F.count("has"), F.count(F.lit(1))).alias("pct"))


@query("SELECT event_type, count(*)::BIGINT AS n, avg(value) > 50 AS high FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def value_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") > 50).alias("high")).orderBy(F.desc("n"), "event_type")


@query("SELECT source AS id, count(*)::BIGINT AS files FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, sf_dir):
    return logs.windowed(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))

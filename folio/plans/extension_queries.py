"""Streams, and operations the built-in engine adds: event-time windows, sessions, rollups, set operations, relational
reports over the star schema. Streams run to the end of what is there and are read back from what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import scoring
from folio.operators.events import classified
from folio.operators.ordered import carried
from folio.plans.catalog import SQL, query
from folio.plans.score_queries import CLASS, CONSENSUS
from folio.session import shared_dir, table
from folio.streaming import streams


def _stream(spark, d: str, name: str) -> DataFrame:
    # a pattern, as a table may be a file or a folder of files
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _run(stream: DataFrame, spark, mode: str) -> DataFrame:
    """A stream to its end: each batch is written whole under its number, so a repeated batch replaces itself."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/data/epoch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data/epoch=*")


@query("str1_stream_consensus", CONSENSUS)
def str1(spark, d):
    out = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    streams.keep_scores(_stream(spark, d, "score_history"), f"{out}/table", f"{out}/result", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/result")


@query("str3_stream_recovery", SQL["str3_recovery"])
def str3_stream(spark, d):
    rows = _stream(spark, d, "events").select("user_id", "event_id", classified(F.col("event_type"), CLASS).alias("class"))
    return _run(streams.recover(rows, "user_id", "event_id", "class"), spark, "append").select("user_id", "event_id", "action")


@query("win_stream_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str7_stream(spark, d):
    rows = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # event time has a zone
    w = streams.tumbling(rows, "ts", ["event_type"], "1 hour", "30 days", "value")
    kept = _run(w, spark, "update").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return kept.groupBy("window_start", "event_type").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query(
    "str6_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM k GROUP BY user_id, k",
)
def str6_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours", "30 days")


@query(
    "win_sliding",
    "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2",
)
def sliding(spark, d):
    return streams.sliding(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "30 minutes", "30 days")


@query("ext_rollup", "SELECT model_name, category, count(*) AS n, round(sum(score), 4) AS total FROM (SELECT DISTINCT book_seq, model_name, category, score FROM score_history WHERE score IS NOT NULL) GROUP BY ROLLUP (model_name, category)")
def rollup(spark, d):
    rows = table(spark, d, "score_history").where("score is not null").select("book_seq", "model_name", "category", "score").distinct()
    return rows.rollup("model_name", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("ext_distinct_models", "SELECT model_name FROM model_outputs WHERE model_name IS NOT NULL INTERSECT SELECT model1 FROM manifests EXCEPT SELECT fusion FROM manifests WHERE fusion IS NOT NULL")
def set_ops(spark, d):
    m = table(spark, d, "manifests")
    a = table(spark, d, "model_outputs").where("model_name is not null").select("model_name")
    return a.intersect(m.select("model1")).subtract(m.where("fusion is not null").select("fusion"))


@query(
    "ext_as_of_scores",
    "SELECT e.user_id, e.event_id, (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.event_id <= e.event_id) AS last_purchase FROM events e",
)
def as_of(spark, d):
    """As-of: the newest purchase of a user up to each event, by one pass over blocks of events instead of a join."""
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return carried(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", bought, "last_purchase").drop("event_type")


@query(
    "rel_pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
def pricing(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(
    "rel_nation_revenue",
    "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def revenue(spark, d):
    t = lambda n: table(spark, d, n)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))  # before the join
    joined = per_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    per_nation = joined.groupBy("c_nationkey").agg(F.sum("v").alias("v")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return per_nation.groupBy("n_name", "r_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("rel_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, d):
    """A top-k report: no sort of the whole table."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("agg2_weighted_scores", "SELECT book_seq, category, round(sum(0.5 * ln(1 + coalesce(hits, 0))), 6) AS weighted FROM (SELECT DISTINCT book_seq, model_name, category, hits FROM score_history) GROUP BY 1, 2")
def agg2(spark, d):
    rows = table(spark, d, "score_history").select("book_seq", "model_name", "category", "hits").distinct()
    return rows.groupBy("book_seq", "category").agg(F.round(F.sum(0.5 * F.log1p(F.coalesce("hits", F.lit(0)))), 6).alias("weighted"))


@query("win3_book_winners", "WITH h AS (SELECT DISTINCT book_seq, model_name, category, CASE WHEN coalesce(false_positives, 0) = 0 THEN score ELSE greatest(score - least(0.1 * false_positives, 0.3 * score), 0.0) END AS score FROM score_history WHERE score IS NOT NULL) SELECT book_seq, category, model_name FROM (SELECT *, row_number() OVER (PARTITION BY book_seq, category ORDER BY score DESC, model_name) AS r FROM h) WHERE r = 1")
def win3(spark, d):
    rows = scoring.history(table(spark, d, "score_history"))
    return scoring.book_winners(rows)

"""Walks along reading order and parents, expected counts, and questions under several modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


@query("SELECT o_orderkey, 'c' || c_custkey || '>' || 'n' || n_nationkey || '>' || 'r' || r_regionkey AS ancestors, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j21_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """The parents of each order up to the root, three levels up."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    up = o.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return up.select("o_orderkey", F.concat(F.lit("c"), "c_custkey", F.lit(">n"), "n_nationkey", F.lit(">r"), "r_regionkey").alias("ancestors"), "r_name")


@query("SELECT n_nationkey, count(s_suppkey) AS suppliers, coalesce(array_to_string(list(s_name ORDER BY s_suppkey)[1:5], '; '), '') AS first_five FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_nationkey")
def a22_collect_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first five children of each node, in order; ranks are cut before anything is gathered."""
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey", "s_suppkey", "s_name")
    few = s.withColumn("rn", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("rn <= 5")
    named = few.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x.s_name), "; ").alias("first_five"))
    counts = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    n = table(spark, d, "nation").select("n_nationkey")
    return n.join(counts, n.n_nationkey == counts.s_nationkey, "left").drop("s_nationkey").join(named, n.n_nationkey == named.s_nationkey, "left").select("n_nationkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("first_five", F.lit("")).alias("first_five"))


@query("SELECT item_id, mode, CASE mode WHEN 'exact' THEN length(text) WHEN 'short' THEN least(length(text), 80) ELSE 0 END AS chars FROM benchmark, (VALUES ('exact'), ('short'), ('none')) m(mode)")
def j23_question_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each question under each of three modes, dealt out in place."""
    n = F.length("text")
    modes = F.explode(F.array(F.struct(F.lit("exact").alias("mode"), n.alias("chars")), F.struct(F.lit("short").alias("mode"), F.least(n, F.lit(80)).alias("chars")), F.struct(F.lit("none").alias("mode"), F.lit(0).alias("chars")))).alias("m")
    return table(spark, d, "benchmark").select("item_id", modes).select("item_id", "m.mode", "m.chars")


@query("SELECT e.event_type, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS missing FROM (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error'), ('refund')) e(event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) c ON e.event_type = c.event_type")
def a23_expected_types(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all expected types, those that don't occur too."""
    expected = spark.range(1).select(F.explode(F.array(*map(F.lit, ["view", "click", "signup", "purchase", "error", "refund"]))).alias("event_type"))
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return expected.join(counts, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("SELECT conv_id, turn, text, 'P' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS label FROM conversations WHERE role = 'assistant' AND length(text) >= 20")
def f7_evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels are given after the gate, so they have no holes."""
    kept = table(spark, d, "conversations").where((F.col("role") == "assistant") & (F.length("text") >= 20))
    label = F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    return kept.select("conv_id", "turn", "text", label.alias("label"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND (c_acctbal > 0 OR c_nationkey < 5)")
def f20_property_filter(spark: SparkSession, d: str) -> DataFrame:
    """Properties that differ from a value; null properties drop out."""
    return table(spark, d, "customer").where("c_mktsegment <> 'BUILDING' and (c_acctbal > 0 or c_nationkey < 5)").select("c_custkey", "c_mktsegment")


@query("SELECT n_name AS node, s_suppkey AS neighbour, coalesce(nullif(s_name, ''), 's' || s_suppkey) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j22_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    name = F.coalesce(F.nullif(F.col("s_name"), F.lit("")), F.concat(F.lit("s"), "s_suppkey"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("node"), F.col("s_suppkey").alias("neighbour"), name.alias("name"))

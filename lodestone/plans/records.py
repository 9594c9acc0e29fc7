"""Record rules, look-up joins, and aggregations of documents, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import table
from .registry import query

CODED = "SELECT o_orderkey, o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '/' || o_orderstatus WHEN 1 THEN '/2020' WHEN 2 THEN '/2020/' || o_orderstatus || '-X' WHEN 3 THEN '/2020/17' ELSE '' END AS code FROM orders"


@query(f"SELECT o_orderkey, code, CASE len(string_split(code, '/')) WHEN 1 THEN false WHEN 2 THEN regexp_matches(string_split(code, '/')[2], '\\p{{L}}') ELSE regexp_matches(string_split(code, '/')[3], '\\p{{L}}') END AS valid FROM ({CODED})")
def f13_doc_number_validity(spark: SparkSession, d: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tail = F.when(k % 5 == 0, F.concat(F.lit("/"), status)).when(k % 5 == 1, "/2020").when(k % 5 == 2, F.concat(F.lit("/2020/"), status, F.lit("-X"))).when(k % 5 == 3, "/2020/17").otherwise("")
    return table(spark, d, "orders").select(k, F.concat(k.cast("string"), tail).alias("code")).withColumn("valid", rules.doc_number_ok(F.col("code")))


@query("SELECT event_id, event_type, round(least(greatest(coalesce(value, 0.7), 0), 1), 6) AS confidence, substr(props, 1, 200) AS evidence FROM events WHERE event_type IN ('view', 'click', 'purchase') AND trim(props) <> ''")
def f16_entity_validate(spark: SparkSession, d: str) -> DataFrame:
    """Records of a known type with evidence, confidence held to [0, 1]."""
    kept = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase") & (F.trim("props") != ""))
    return kept.select("event_id", "event_type", F.round(rules.confidence(F.col("value")), 6).alias("confidence"), F.substring("props", 1, 200).alias("evidence"))


ASKED = """SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(coalesce(text, ''), '[0-9]+')) FILTER (role = 'user'))) AS asked, list_distinct(flatten(list(regexp_extract_all(coalesce(text, ''), '[0-9]+')) FILTER (role = 'assistant'))) AS said FROM conversations GROUP BY conv_id"""


@query(f"SELECT conv_id, len([x FOR x IN coalesce(said, []) IF NOT list_contains(coalesce(asked, []), x)])::BIGINT AS n_new, len([x FOR x IN coalesce(said, []) IF NOT list_contains(coalesce(asked, []), x)]) = 0 AS faithful FROM ({ASKED})")
def f19_reference_faithful(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose answers name no number that no question has."""
    found = table(spark, d, "conversations").select("conv_id", "role", F.explode_outer(rules.numbers(F.coalesce("text", F.lit("")))).alias("x"))
    seen = found.groupBy("conv_id", "x").agg(F.max((F.col("role") == "user").cast("int")).alias("asked"), F.max((F.col("role") == "assistant").cast("int")).alias("said"))
    new = F.count_if(F.col("x").isNotNull() & (F.col("said") == 1) & (F.col("asked") == 0))
    return seen.groupBy("conv_id").agg(new.alias("n_new")).withColumn("faithful", F.col("n_new") == 0)


@query("SELECT p_partkey, least(a, b) AS low FROM (SELECT p_partkey, round(p_size / 50.0::DOUBLE, 6) AS a, round(p_retailprice / 2000.0::DOUBLE, 6) AS b FROM part) WHERE least(a, b) < 0.7")
def f22_low_score_slice(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose least metric is under 0.7."""
    low = F.least(F.round(F.col("p_size") / 50.0, 6), F.round(F.col("p_retailprice") / 2000.0, 6))
    return table(spark, d, "part").select("p_partkey", low.alias("low")).where("low < 0.7")


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 0) AS score FROM lineitem")
def f24_unified_score(spark: SparkSession, d: str) -> DataFrame:
    """Zero falls through to the next score."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.first_score(F.col("l_discount"), F.col("l_tax")).alias("score"))


@query(r"""SELECT doc_id, '[' || concat_ws(' | ', CASE WHEN length(t) > 140 THEN substr(t, 1, 139) || '…' ELSE t END, 'Điều ' || (doc_id % 7)::VARCHAR, doc_id::VARCHAR) || ']' AS citation
FROM (SELECT doc_id, trim(regexp_replace(CASE WHEN contains(text, source) THEN text ELSE text || ' (' || source || ')' END, '[ \t\n\r]+', ' ', 'g')) AS t FROM documents)""")
def f25_citation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", rules.cited(F.col("text"), F.col("source"), F.col("doc_id") % 7, F.col("doc_id")).alias("citation"))


@query("SELECT md5(text) AS md5, count(DISTINCT lang || '/' || source) AS kinds FROM documents GROUP BY text HAVING count(DISTINCT lang || '/' || source) > 1")
def j5_metadata_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts that disagree on language or source."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("md5"), F.concat("lang", F.lit("/"), "source").alias("kind"))
    return rows.groupBy("md5").agg(F.countDistinct("kind").alias("kinds")).where("kinds > 1")


@query("SELECT s_suppkey, coalesce('n' || n_nationkey, raw) AS nation FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE n_name END AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN nation ON lower(raw) = lower(n_name)")
def j8_key_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Names to ids, without regard to case; a name that isn't known stays."""
    n = table(spark, d, "nation")
    raw = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "UNKNOWN").otherwise(F.col("n_name")).alias("raw"))
    known = n.select(F.lower("n_name").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("id")).groupBy("key").agg(F.min("id").alias("id"))
    return raw.join(known, F.lower("raw") == F.col("key"), "left").select("s_suppkey", F.coalesce("id", "raw").alias("nation"))


ENDS = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_nationkey::VARCHAR WHEN 1 THEN n_name ELSE 'nowhere' END AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT c_custkey, coalesce(a.n_nationkey, b.n_nationkey, -1) AS nation FROM ({ENDS}) r LEFT JOIN nation a ON ref = a.n_nationkey::VARCHAR LEFT JOIN nation b ON ref = b.n_name")
def j9_or_key_join(spark: SparkSession, d: str) -> DataFrame:
    """A reference by id or by name, -1 where neither fits: two equi joins instead of an OR."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    refs = c.join(n, c.c_nationkey == n.n_nationkey).select(k, F.when(k % 3 == 0, F.col("c_nationkey").cast("string")).when(k % 3 == 1, F.col("n_name")).otherwise("nowhere").alias("ref"))
    by_id, by_name = n.select(F.col("n_nationkey").cast("string").alias("ref"), F.col("n_nationkey").alias("x")), n.select(F.col("n_name").alias("ref"), F.col("n_nationkey").alias("y"))
    return refs.join(by_id, "ref", "left").join(by_name, "ref", "left").select("c_custkey", F.coalesce("x", "y", F.lit(-1)).alias("nation"))


@query("SELECT l_orderkey, l_linenumber, coalesce('p' || p_partkey, 'missing:' || l_partkey) AS part, p_partkey IS NULL AS placeholder FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size >= 25) ON l_partkey = p_partkey")
def j25_reference_placeholder(spark: SparkSession, d: str) -> DataFrame:
    """References to parts that aren't kept get a placeholder."""
    kept = table(spark, d, "part").where("p_size >= 25").select("p_partkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(kept, F.col("l_partkey") == F.col("p_partkey"), "left")
    name = F.coalesce(F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("missing:"), "l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", name.alias("part"), F.col("p_partkey").isNull().alias("placeholder"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j11_semi_join(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def a3_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Different sources and texts by language; texts by their digest, so that they aren't shuffled whole."""
    return table(spark, d, "documents").select("lang", "source", F.md5("text").alias("md5")).groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("md5").alias("texts"))


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS md5 FROM conversations GROUP BY conv_id")
def a10_parent_build(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation joined in order into one parent."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.md5(text).alias("md5"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '') AS priority FROM orders GROUP BY o_custkey")
def a13_first_non_empty(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_orderpriority") != "", F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(value, F.when(value.isNotNull(), F.col("o_orderkey"))).alias("priority"))


@query("SELECT user_id, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean, round(median(value) FILTER (event_type <> 'error'), 6) AS median, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def a17_means_and_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures are counted but stay out of mean and median."""
    good = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(good), 6).alias("mean"), F.round(F.median(good), 6).alias("median"), F.count_if(F.col("event_type") == "error").alias("failures"))


@query("SELECT warning, count(*) AS n FROM (SELECT unnest([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, chr(65533)) THEN 'replaced' END]) AS warning FROM documents) WHERE warning IS NOT NULL GROUP BY warning")
def a19_warning_counts(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("n_chars") > 5000, "long"), F.when(F.contains("text", F.lit("�")), "replaced")))
    return table(spark, d, "documents").select(F.explode(found).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query("SELECT types, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) AS types FROM events GROUP BY user_id) GROUP BY types")
def a20_overlap_distribution(spark: SparkSession, d: str) -> DataFrame:
    """How many users have how many types of event."""
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("types")).groupBy("types").agg(F.count("*").alias("users"))


@query("SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS part_chars, sum(length(text))::BIGINT AS whole_chars, CASE WHEN sum(length(text)) > 0 THEN round(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::DOUBLE / sum(length(text)), 6) ELSE 0 END AS ratio FROM conversations GROUP BY conv_id")
def a21_context_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    sums = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("part_chars"), F.sum(n).alias("whole_chars"))
    return sums.withColumn("ratio", F.when(F.col("whole_chars") > 0, F.round(F.col("part_chars") / F.col("whole_chars"), 6)).otherwise(0.0))


@query("SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 10")
def a25_top_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS by_price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice DESC) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS change FROM lineitem")
def w2_rank_change(spark: SparkSession, d: str) -> DataFrame:
    """Rank by price within an order, and how far that is above the line's own rank."""
    w = Window.partitionBy("l_orderkey")
    new, old = F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")), F.row_number().over(w.orderBy("l_linenumber", "l_partkey", F.desc("l_extendedprice")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", new.alias("by_price"), (old - new).alias("change"))


@query("SELECT doc_id, count(*) OVER w > 1 AS duplicate, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS repeat FROM documents WINDOW w AS (PARTITION BY md5(text))")
def w12_duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates flagged twice: all of them, and all but the first.  Counts and firsts by digest are joined back, so no group of copies is
    gathered in one task."""
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))
    more = rows.groupBy("md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    found = rows.join(more, "md5", "left")
    return found.select("doc_id", F.col("n").isNotNull().alias("duplicate"), (F.col("n").isNotNull() & (F.col("doc_id") > F.col("first"))).alias("repeat"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def w14_best_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event of the greatest value, the least id on ties."""
    best = F.max(F.struct("value", (-F.col("event_id")).alias("minus"))).alias("best")
    return table(spark, d, "events").groupBy("user_id").agg(best).select("user_id", (-F.col("best.minus")).alias("event_id"), "best.value")

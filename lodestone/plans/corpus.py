"""Chunking, extraction, profiling, upserts and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import strings as S
from ..functions import text as X
from ..operators import chunking
from ..sources import sinks
from ..sources.tables import table, views
from .registry import query

FIXED = "f AS (SELECT doc_id, text, unnest(range(0, 1 + ceil(greatest(length(text) - 1200, 0) / 1050.0)::INT)) AS chunk FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, chunk, substr(text, (chunk * 1050 + 1)::BIGINT, 1200) AS text FROM f)"


@query(f"WITH {FIXED} SELECT doc_id, chunk, length(text) AS n, md5(text) AS md5 FROM c")
def w9_chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed(table(spark, d, "documents")).select("doc_id", "chunk", F.length("text").alias("n"), F.md5("text").alias("md5"))


@query(f"WITH {FIXED}, p AS (SELECT 'paragraph' AS strategy, length(trim(x)) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''), a AS (SELECT 'fixed' AS strategy, length(text) AS n FROM c UNION ALL SELECT * FROM p) SELECT strategy, count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean FROM a GROUP BY ALL")
def a2_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = chunking.fixed(docs).select(F.lit("fixed").alias("strategy"), "text").unionByName(chunking.paragraphs(docs).select(F.lit("paragraph").alias("strategy"), "text"))
    n = F.length("text")
    return rows.groupBy("strategy").agg(F.count("*").alias("chunks"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 2).alias("mean"))


@query("""WITH g AS (SELECT conv_id, list({'w': [{'items': 1::BIGINT, 'chars': length(text)::BIGINT}]} ORDER BY turn, length(text)) AS xs FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(xs, lambda a, x: CASE WHEN a.w[-1].chars + 2 + x.w[1].chars <= 600 THEN {'w': list_append(a.w[:-2], {'items': a.w[-1]['items'] + 1, 'chars': a.w[-1].chars + 2 + x.w[1].chars})} ELSE {'w': list_append(a.w, x.w[1])} END).w AS ws FROM g)
SELECT conv_id, generate_subscripts(ws, 1) - 1 AS "window", unnest(ws)['items'] AS items, unnest(ws).chars AS chars FROM f""")
def w5_pack_windows(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation packed greedily into windows of 600 characters."""
    return chunking.packed(table(spark, d, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n", 600)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_carried FROM conversations")
def w3_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return chunking.carried(rows, "conv_id", "turn", "asked").drop("asked")


@query("SELECT l_orderkey, l_linenumber, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next_id FROM lineitem")
def w10_next_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("next_id", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def w13_topn_longest(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def w11_dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT c AS column_name, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (v = '') AS empties, count(DISTINCT v) AS different FROM (SELECT 'text' AS c, text::VARCHAR AS v FROM documents UNION ALL SELECT 'lang' AS c, lang::VARCHAR AS v FROM documents UNION ALL SELECT 'source' AS c, source::VARCHAR AS v FROM documents UNION ALL SELECT 'n_chars' AS c, n_chars::VARCHAR AS v FROM documents) GROUP BY c")
def a4_null_profile(spark: SparkSession, d: str) -> DataFrame:
    cols = ["text", "lang", "source", "n_chars"]
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in cols)
    rows = table(spark, d, "documents").selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, v)")
    return rows.groupBy("column_name").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == "").alias("empties"), F.countDistinct("v").alias("different"))


@query("SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def a5_dup_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5")).groupBy("md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT l.l_partkey % 7 AS bucket, count(*) AS n FROM lineitem l ANTI JOIN (SELECT p_partkey FROM part WHERE p_size < 25) p ON l.l_partkey = p.p_partkey GROUP BY ALL")
def j14_fk_check(spark: SparkSession, d: str) -> DataFrame:
    """Line items without a part below size 25, counted by a bucket of their key."""
    parts = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_partkey").join(parts, "l_partkey", "left_anti").groupBy((F.col("l_partkey") % 7).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, is_new, event_id)) AS event_id, max(ts) AS ts FROM (SELECT *, event_id % 2 AS is_new FROM events) GROUP BY ALL""")
def k4_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Odd events merged over even ones: the latest of each user and type stays."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return sinks.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name, c_acctbal FROM customer WHERE c_custkey % 2 <> 0")
def k6_merge_create_only(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sinks.merge_create_only(c.where("c_custkey % 2 = 0"), c.withColumn("c_name", F.concat(F.lit("new "), "c_name")), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def k7_merge_overwrite(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return sinks.merge_overwrite(c.where("c_custkey % 2 = 0"), new, "c_custkey")


@query("SELECT lang, min(n_chars) AS least, median(n_chars) AS median, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most FROM documents GROUP BY lang")
def a18_size_distribution(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "documents")
    return spark.sql("SELECT lang, min(n_chars) least, median(n_chars) median, cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS bigint) p95, max(n_chars) most FROM documents GROUP BY lang")


@query("SELECT lang, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS rn FROM (SELECT lang, source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang, source)) WHERE rn = 1")
def a12_mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.groupBy("lang").agg(F.max_by("source", F.struct("n", -F.col("first"))).alias("source"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(stddev_samp(value), 6) AS sd FROM events GROUP BY event_type")
def a26_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(f(v), 6).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"), (F.stddev_samp, "sd"))])


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def a27_means_by_sets(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "documents")
    return spark.sql("SELECT coalesce(lang, 'all') lang, coalesce(source, 'all') source, count(*) n, round(avg(n_chars), 4) mean FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id) AS rn FROM documents) WHERE rn <= 5")
def a32_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id").withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND event_id % 5 <> 4")
def x34_json_payload(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as they are, in a fence, within prose, and cut-off ones, which have none."""
    props, n = F.col("props"), F.col("event_id") % 5
    made = F.when(n == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), props, F.lit(" as asked"))).when(n == 3, F.concat(F.lit("```\n"), props, F.lit("```"))).when(n == 4, F.substring(props, 1, F.length(props) - 1)).otherwise(props)
    return table(spark, d, "events").select("event_id", F.get_json_object(X.json_payload(made), "$.k").try_cast("bigint").alias("k")).where("k is not null")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE CASE WHEN event_id % 2 = 0 THEN least(greatest(value / 100, 0), 1) ELSE 0.75 END END AS confidence FROM events")
def y7_relation_confidence(spark: SparkSession, d: str) -> DataFrame:
    """By method; a model that says nothing gets its default."""
    k = F.col("event_id")
    method = F.when(k % 3 == 0, "metadata").when(k % 3 == 1, "rule").otherwise("model")
    return table(spark, d, "events").select(k, rules.relation_confidence(method, F.when(k % 2 == 0, F.col("value") / 100)).alias("confidence"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def o4_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def o5_set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def o1_union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


MENTIONS = "m AS (SELECT doc_id, 'name' AS kind, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS form FROM documents UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '[0-9]{4,}')) FROM documents)"


@query(rf"""WITH {MENTIONS}, g AS (SELECT kind, lower(form) AS key, form, count(*) AS n, min(doc_id) AS first FROM m GROUP BY ALL), w AS (SELECT kind, lower(form) AS key, string_agg(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'rule' ELSE 'model' END, ' | ' ORDER BY CASE WHEN doc_id % 2 = 0 THEN 'rule' ELSE 'model' END) AS methods FROM m GROUP BY ALL)
SELECT kind, key, arg_max(form, (n, form)) AS canonical, string_agg(form, ' | ' ORDER BY form) AS forms, sum(n)::BIGINT AS mentions, min(first) AS first_doc, any_value(methods) AS methods FROM g JOIN w USING (kind, key) GROUP BY kind, key""")
def a14_entity_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of words and numbers by kind and key: the most frequent form, all forms, mentions, first document and methods.  A document's
    number says which method found it."""
    docs, method = table(spark, d, "documents"), F.when(F.col("doc_id") % 2 == 0, "rule").otherwise("model")
    found = lambda kind, p: docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(p), 0)).alias("form"))
    m = found("name", r"[A-Z][a-z]{5,}").unionByName(found("number", "[0-9]{4,}"))
    g = m.groupBy("kind", "form").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.collect_set(method).alias("ways"))
    out = g.groupBy("kind", F.lower("form").alias("key")).agg(F.max(F.struct("n", "form")).alias("best"), F.array_join(F.array_sort(F.collect_set("form")), " | ").alias("forms"), F.sum("n").alias("mentions"), F.min("first").alias("first_doc"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ways")))), " | ").alias("methods"))
    return out.select("kind", "key", F.col("best.form").alias("canonical"), "forms", "mentions", "first_doc", "methods")


CITING = "'Căn cứ Luật số ' || doc_id || '/2020/QH14 và 12/03/2020, ' || substr(text, 1, 250) || ' thay thế 5/TT-X; ' || substr(text, 251, 450) || ' bãi bỏ ' || (doc_id % 7) || '/2019/ND-CP. ' || text"


@query(rf"""WITH t AS (SELECT doc_id, doc_id || '/2020/QH14' AS own, {CITING} AS body FROM documents),
p AS (SELECT doc_id, own, body, trigger, unnest(range(1, length(body) + 1)) AS pos FROM t, (VALUES ('Căn cứ'), ('Sửa đổi, bổ sung'), ('bãi bỏ'), ('thay thế')) v(trigger)),
w AS (SELECT doc_id, own, trigger, pos, substr(body, greatest(pos - 200, 1), pos + 400 - greatest(pos - 200, 1)) AS win FROM p WHERE substr(body, pos, length(trigger)) = trigger),
n AS (SELECT *, regexp_extract_all(win, '{S.NUMBER}') AS found, regexp_split_to_array(win, '{S.NUMBER}') AS parts FROM w WHERE regexp_matches(win, '{S.NUMBER}')),
c AS (SELECT doc_id, own, trigger, pos, win, i, found[i] AS code, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS before FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM n)),
k AS (SELECT doc_id, trigger, code, pos, i, trim(substr(win, (greatest(before - 80, 0) + 1)::BIGINT, (before + length(code) + 80 - greatest(before - 80, 0))::BIGINT)) AS evidence FROM c
  WHERE code <> own AND NOT starts_with(own, code || '/') AND CASE WHEN len(string_split(code, '/')) = 2 THEN regexp_matches(string_split(code, '/')[2], '\p{{L}}') WHEN len(string_split(code, '/')) > 2 THEN regexp_matches(string_split(code, '/')[3], '\p{{L}}') ELSE false END)
SELECT doc_id, trigger, code, arg_min(evidence, (pos, i)) AS evidence FROM k GROUP BY doc_id, trigger, code""")
def x20_extract_codes(spark: SparkSession, d: str) -> DataFrame:
    """Document numbers near the trigger words of each text, once by trigger, with the first one's surroundings; the document's own
    number and its beginnings are left out."""
    k, text = F.col("doc_id"), F.col("text")
    n = k.cast("string")
    body = F.concat(F.lit("Căn cứ Luật số "), n, F.lit("/2020/QH14 và 12/03/2020, "), F.substring(text, 1, 250), F.lit(" thay thế 5/TT-X; "), F.substring(text, 251, 450), F.lit(" bãi bỏ "), (k % 7).cast("string"), F.lit("/2019/ND-CP. "), text)
    return S.citing(table(spark, d, "documents").select("doc_id", F.concat(n, F.lit("/2020/QH14")).alias("own"), body.alias("body")))

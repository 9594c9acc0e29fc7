"""Filters, joins, orders, unions and composite steps over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search
from ..sources.tables import table
from .registry import query


@query("SELECT doc_id, n_chars, max(n_chars < 200) OVER (PARTITION BY source) AS fallback FROM documents")
def s4_extraction_fallback(spark: SparkSession, d: str) -> DataFrame:
    """One bad page sends its whole file to the other reader; flags are aggregated and joined, so no file is one task."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    bad = docs.groupBy("source").agg(F.bool_or(F.col("n_chars") < 200).alias("fallback"))
    return docs.join(bad, "source").select("doc_id", "n_chars", "fallback")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def f1_strategy_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id")


@query("SELECT l_orderkey, l_linenumber, array_to_string([x FOR x IN [CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_shipdate < o_orderdate THEN 'shipped before ordered' END, CASE WHEN l_discount > 0.08 THEN 'discount' END] IF x IS NOT NULL], ',') AS faults FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f2_record_validation(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each record, in order of the rules."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    faults = F.array_compact(F.array(F.when(F.col("l_quantity") > 45, "quantity"), F.when(F.col("l_shipdate") < F.col("o_orderdate"), "shipped before ordered"), F.when(F.col("l_discount") > 0.08, "discount")))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(faults, ",").alias("faults"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'dimension' WHEN vec_id % 3 = 1 THEN 'zero' ELSE '' END AS faults FROM embeddings")
def f3_vector_validation(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("embedding"), F.col("vec_id") % 3
    made = F.when(k == 0, F.slice(e, 1, 63)).when(k == 1, F.transform(e, lambda x: x * 0)).otherwise(e)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(X.vector_faults(made, 64), ",").alias("faults"))


@query("SELECT event_id, round(1 - value / 500, 6) AS distance, round(1 - value / 500, 6) <= 0.8 AS accepted FROM events")
def f5_distance_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(1 - F.col("value") / 500, 6).alias("distance")).withColumn("accepted", F.col("distance") <= 0.8)


ROLES = "['staff', 'lead', 'admin'][1:(doc_id % 3 + 1)::INT]"


def _roles() -> Column:
    return F.slice(F.array(F.lit("staff"), F.lit("lead"), F.lit("admin")), 1, (F.col("doc_id") % 3 + 1).cast("int"))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({ROLES}, ['lead', 'auditor']) AND contains(lower(text), 'a') AND contains(lower(text), 'en')")
def f9_roles_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Rows that one of the roles may see and that hold all tokens."""
    low = F.lower("text")
    held = F.forall(F.array(F.lit("a"), F.lit("en")), lambda t: F.contains(low, t))
    return table(spark, d, "documents").where(F.arrays_overlap(_roles(), F.array(F.lit("lead"), F.lit("auditor"))) & held).select("doc_id")


@query("SELECT event_id, array_to_string(CASE event_type WHEN 'view' THEN ['reader'] WHEN 'click' THEN ['reader'] WHEN 'purchase' THEN ['buyer'] ELSE [] END, ',') AS roles FROM events")
def f10_role_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """Old names to canonical ones; unknown names go, repeated ones stay once."""
    known = F.create_map(*map(F.lit, ("view", "reader", "click", "reader", "purchase", "buyer")))
    given = F.array("event_type", F.lit("view-old"), "event_type")
    return table(spark, d, "events").select("event_id", F.array_join(F.array_distinct(F.array_compact(F.transform(given, lambda r: F.try_element_at(known, r)))), ",").alias("roles"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey <> l_suppkey AND NOT starts_with(l_partkey::VARCHAR, l_suppkey || '')")
def f14_self_reference(spark: SparkSession, d: str) -> DataFrame:
    """References to the row's own source, or to a part of it, go."""
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return table(spark, d, "lineitem").where(~((a == b) | F.startswith(a, b))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey, segment FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'unclassified' WHEN 2 THEN NULL ELSE c_mktsegment END AS segment FROM customer) WHERE segment <> '' AND segment <> 'unclassified'")
def f17_placeholder_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    segment = F.when(k == 0, "").when(k == 1, "unclassified").when(k == 3, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", segment.alias("segment")).where(~F.col("segment").isin("", "unclassified"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0")
def f21_zero_score_drop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount > 0").select("l_orderkey", "l_linenumber")


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'p.' || doc_id ELSE 'p.' || doc_id || '-' || (doc_id + 1) END AS page, substr(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 200) AS preview, replace(replace(substr(text, 1, 200), chr(10), '\n'), '|', '\|') AS snippet FROM documents")
def f26_previews(spark: SparkSession, d: str) -> DataFrame:
    """Pages, a preview with blanks collapsed, and a table cell with breaks and bars escaped."""
    k = F.col("doc_id")
    page = F.concat(F.lit("p."), k, F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("-"), k + 1)))
    cell = F.replace(F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\|"))
    return table(spark, d, "documents").select(k, page.alias("page"), F.substring(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), 1, 200).alias("preview"), cell.alias("snippet"))


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j1_inner_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


BRANCHES = "a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ra FROM part WHERE p_size > 40 QUALIFY ra <= 100), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_name, p_partkey) AS rb FROM part WHERE p_brand LIKE '%1' QUALIFY rb <= 100), c AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS rc FROM part WHERE p_type LIKE 'S%' QUALIFY rc <= 100)"


def _ranked(spark: SparkSession, d: str, where: str, *order: Column | str) -> DataFrame:
    """A branch's first hundred with their ranks; only these rows meet in one task."""
    first = table(spark, d, "part").where(where).orderBy(*order).limit(100)
    return first.select(F.col("p_partkey").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("r"))


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _ranked(spark, d, "p_size > 40", F.desc("p_retailprice"), "p_partkey"), _ranked(spark, d, "p_brand like '%1'", "p_name", "p_partkey"), _ranked(spark, d, "p_type like 'S%'", "p_partkey")


@query(f"WITH {BRANCHES} SELECT id, ra, rb FROM a FULL JOIN b USING (id)")
def j2_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """All ids of two branches with a rank from each, null where it has none."""
    a, b, _ = _three(spark, d)
    return a.withColumnRenamed("r", "ra").join(b.withColumnRenamed("r", "rb"), "id", "full")


@query(f"WITH {BRANCHES} SELECT id, ra, rb, rc FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)")
def j3_three_way_outer(spark: SparkSession, d: str) -> DataFrame:
    """Three branches in one shuffle: a union, then one aggregate."""
    parts = [x.withColumn("branch", F.lit(n)) for n, x in zip("abc", _three(spark, d))]
    of = lambda n: F.max(F.when(F.col("branch") == n, F.col("r"))).alias(f"r{n}")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(of("a"), of("b"), of("c"))


@query(f"WITH {BRANCHES} SELECT id, count(*) AS n, min(r) AS best FROM (SELECT id, ra AS r FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id")
def j4_union_join(spark: SparkSession, d: str) -> DataFrame:
    """All queries' hits by item: how many found it and its best rank."""
    a, b, c = _three(spark, d)
    return a.unionByName(b).unionByName(c).groupBy("id").agg(F.count("*").alias("n"), F.min("r").alias("best"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j6_mandatory_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A reference without its row is an error, raised where it is met."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.when(F.col("c_custkey").isNull(), F.raise_error(F.concat(F.lit("no customer "), "o_custkey"))).otherwise(F.col("c_name")).alias("c_name"))


@query("SELECT item_id, doc_id, lang FROM benchmark JOIN documents ON doc_id = item_id * 7 WHERE doc_id IS NOT NULL")
def j7_optional_lookup(spark: SparkSession, d: str) -> DataFrame:
    """References without a row are skipped."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id")).join(docs, "doc_id").select("item_id", "doc_id", "lang")


@query("SELECT c_custkey, e.id AS entity_id, e.id IS NULL AS missed FROM (SELECT c_custkey, upper(c_mktsegment) AS name, c_nationkey % 2 AS t FROM customer) c LEFT JOIN (SELECT DISTINCT lower(c_mktsegment) AS key, 0 AS t, 'E-' || lower(c_mktsegment) AS id FROM customer) e ON lower(c.name) = e.key AND c.t = e.t")
def j10_entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """By kind and name without regard to case; misses are listed."""
    c = table(spark, d, "customer")
    known = c.select(F.lower("c_mktsegment").alias("key")).distinct().select("key", F.lit(0).alias("t"), F.concat(F.lit("E-"), "key").alias("id"))
    asked = c.select("c_custkey", F.lower(F.upper("c_mktsegment")).alias("key"), (F.col("c_nationkey") % 2).alias("t"))
    return asked.join(known, ["key", "t"], "left").select("c_custkey", F.col("id").alias("entity_id"), F.col("id").isNull().alias("missed"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j12_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0")
def j17_equi_join_of_product(spark: SparkSession, d: str) -> DataFrame:
    """A product with a predicate, said as the equi join that it is."""
    s, n = table(spark, d, "supplier").where("s_acctbal > 0"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_nationkey")


@query("SELECT conv_id, bool_or(list_has_any(asked, regexp_extract_all(coalesce(text, ''), '[0-9]+'))) AS kept FROM (SELECT conv_id, text, flatten(list(CASE WHEN turn = 0 THEN regexp_extract_all(coalesce(text, ''), '[0-9]+') ELSE [] END) OVER (PARTITION BY conv_id)) AS asked, turn FROM conversations) WHERE turn > 0 GROUP BY conv_id")
def j26_reference_kept(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of which a later turn keeps a number of the first."""
    found = table(spark, d, "conversations").select("conv_id", "turn", F.explode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), 0)).alias("x"))
    seen = found.groupBy("conv_id", "x").agg(F.max((F.col("turn") == 0).cast("int")).alias("first"), F.max((F.col("turn") > 0).cast("int")).alias("later"))
    both = F.bool_or(F.col("x").isNotNull() & (F.col("first") == 1) & (F.col("later") == 1))
    return seen.groupBy("conv_id").agg(both.alias("kept"), F.max("later").alias("later")).where("later = 1").select("conv_id", "kept")


@query(f"WITH {BRANCHES} SELECT count(*) AS n, count(*) FILTER (ra <> rb) AS moved, count(*) FILTER (ra = 1 OR rb = 1) AS top_changed, count(*) FILTER (rb < ra) AS better FROM a JOIN b USING (id)")
def a31_rerank_stats(spark: SparkSession, d: str) -> DataFrame:
    """How a second ranking moved what both rank."""
    a, b, _ = _three(spark, d)
    both = a.withColumnRenamed("r", "ra").join(b.withColumnRenamed("r", "rb"), "id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("ra") != F.col("rb")).alias("moved"), F.count_if((F.col("ra") == 1) | (F.col("rb") == 1)).alias("top_changed"), F.count_if(F.col("rb") < F.col("ra")).alias("better"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w1_unique_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks without ties or holes within a result list."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag ROWS UNBOUNDED PRECEDING) AS chapter FROM lineitem")
def w4_chapter_by_offset(spark: SparkSession, d: str) -> DataFrame:
    """The last mark at or before each row."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.last(mark, ignorenulls=True).over(w).alias("chapter"))


@query("SELECT name, printf('E%06d', row_number() OVER (ORDER BY name)) AS entity_id FROM (SELECT DISTINCT c_name AS name FROM customer)")
def w15_sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in order of names without one task for all: see numbered()."""
    names = table(spark, d, "customer").select(F.col("c_name").alias("name")).distinct()
    return search.numbered(names, ["name"], "k").select("name", F.format_string("E%06d", "k").alias("entity_id"))


@query(f"WITH {BRANCHES} SELECT id, round(coalesce(0.6 / (60 + ra), 0) + coalesce(0.4 / (60 + rb), 0), 9) AS score FROM a FULL JOIN b USING (id) ORDER BY score DESC, least(coalesce(ra, 1000000000), coalesce(rb, 1000000000)), coalesce(rb, 1000000000), coalesce(ra, 1000000000), id LIMIT 20")
def t4_weighted_order(spark: SparkSession, d: str) -> DataFrame:
    """Score, best branch rank, each branch's rank, id; a missing rank comes last."""
    a, b, _ = _three(spark, d)
    both = a.withColumnRenamed("r", "ra").join(b.withColumnRenamed("r", "rb"), "id", "full")
    ra, rb = (F.coalesce(c, F.lit(1_000_000_000)) for c in ("ra", "rb"))
    score = F.round(F.coalesce(0.6 / (60 + F.col("ra")), F.lit(0.0)) + F.coalesce(0.4 / (60 + F.col("rb")), F.lit(0.0)), 9)
    return both.withColumn("score", score).orderBy(F.desc("score"), F.least(ra, rb), rb, ra, "id").limit(20).select("id", "score")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def t10_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first that are permitted: the filter comes before the cut, which gives the walk's rows."""
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query("SELECT item_id, len(list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z]{4,}') IF x < 'm']))::INT AS matched FROM benchmark ORDER BY matched DESC, item_id LIMIT 10")
def t11_matched_tokens_order(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0), lambda x: x < "m"))
    return table(spark, d, "benchmark").select("item_id", F.size(words).alias("matched")).orderBy(F.desc("matched"), "item_id").limit(10)


@query("SELECT name, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n NULLS LAST, name) AS place FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'Q' || chr((65 + o_orderkey % 26)::INT) || o_orderkey || 'x' ELSE 'Q' || o_orderkey END AS name, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS n FROM orders)")
def t14_natural_order(spark: SparkSession, d: str) -> DataFrame:
    """By the number at the end of a name, those without one last."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Q"), F.char((65 + k % 26).cast("int")), k, F.lit("x"))).otherwise(F.concat(F.lit("Q"), k))
    n = F.nullif(F.regexp_extract("name", r"([0-9]+)$", 1), F.lit("")).cast("long")
    rows = table(spark, d, "orders").select("o_orderstatus", name.alias("name")).withColumn("n", n)
    return rows.select("name", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.asc_nulls_last("n"), "name")).alias("place"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'supplied' AS kind FROM lineitem UNION SELECT o_custkey, o_orderkey, 'ordered' FROM orders")
def o2_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("supplied").alias("kind"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("ordered").alias("kind"))
    return a.unionByName(b).distinct()


@query("SELECT key, arg_min(origin, p) AS origin FROM (SELECT lower(p_type) AS key, 'metadata' AS origin, 0 AS p FROM part WHERE p_size > 30 UNION ALL SELECT lower(p_type), 'model', 1 FROM part) GROUP BY key")
def o7_metadata_first(spark: SparkSession, d: str) -> DataFrame:
    """Entities of two origins, once by name without regard to case; metadata comes first."""
    p = table(spark, d, "part")
    rows = p.where("p_size > 30").select(F.lower("p_type").alias("key"), F.lit("metadata").alias("origin"), F.lit(0).alias("p")).unionByName(p.select(F.lower("p_type").alias("key"), F.lit("model").alias("origin"), F.lit(1).alias("p")))
    return rows.groupBy("key").agg(F.min_by("origin", "p").alias("origin"))


@query("SELECT doc_id, CASE WHEN NOT original IN ('', 'unclassified') THEN original ELSE coalesce(suggested, original) END AS value, CASE WHEN NOT original IN ('', 'unclassified') THEN 'metadata' WHEN suggested IS NOT NULL THEN 'model' ELSE 'missing' END AS method FROM (SELECT doc_id, (['', 'unclassified', source])[doc_id % 3 + 1] AS original, CASE WHEN doc_id % 2 = 0 THEN lang END AS suggested FROM documents)")
def z13_enrichment_merge(spark: SparkSession, d: str) -> DataFrame:
    """A suggestion counts only where the original says nothing."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(k, F.when(k % 3 == 0, "").when(k % 3 == 1, "unclassified").otherwise(F.col("source")).alias("original"), F.when(k % 2 == 0, F.col("lang")).alias("suggested"))
    said = ~F.col("original").isin("", "unclassified")
    return rows.select(k, F.when(said, F.col("original")).otherwise(F.coalesce("suggested", "original")).alias("value"), F.when(said, "metadata").when(F.col("suggested").isNotNull(), "model").otherwise("missing").alias("method"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE json_extract_string(props, '$.k') END AS INT) AS k, CASE WHEN event_id % 7 = 0 THEN 'not a number' END AS error FROM events")
def z14_row_isolation(spark: SparkSession, d: str) -> DataFrame:
    """A row that fails has an error, the others go on."""
    raw = F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.get_json_object("props", "$.k"))
    k = raw.try_cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(raw.isNotNull() & k.isNull(), "not a number").alias("error"))

"""Graph queries over customers, nations, regions and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import graph, search
from ..sources import sinks
from ..sources.tables import table
from .registry import query


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Nation in region, supplier in nation."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("IN").alias("type"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("OF").alias("type"))
    return n.unionByName(s)


EDGES = "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'OF' FROM supplier), b AS (SELECT src, dst, src || '|' || type || '|' || dst AS edge FROM e UNION ALL SELECT dst, src, src || '|' || type || '|' || dst FROM e)"


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, []::VARCHAR[] AS used, 'r' || r_regionkey AS path, 0 AS hops FROM region
UNION ALL SELECT seed, dst, list_append(used, edge), path || '>' || dst, hops + 1 FROM t JOIN b ON node = b.src WHERE hops < 2 AND NOT list_contains(used, edge))
SELECT seed, node, hops, path, round(pow(0.85, hops), 6) AS score FROM t WHERE hops > 0 AND node <> seed""")
def j18_hop_expand(spark: SparkSession, d: str) -> DataFrame:
    """Trails of one or two edges from each region."""
    return graph.hops(_edges(spark, d), table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")), 2)


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS node, 0 AS hops FROM nation
UNION SELECT seed, dst, hops + 1 FROM t JOIN b ON node = b.src WHERE hops < 4) SELECT seed, node, min(hops) AS hops FROM t GROUP BY ALL HAVING min(hops) > 0""")
def j20_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Least hops, up to four, from each nation."""
    return graph.distances(_edges(spark, d), table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), 4)


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j16_path_two_hop(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j13_not_exists_orphans(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def j15_optional_match(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def a1_count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY type")
def a23_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("SELECT coalesce(a.nation, b.nation) AS nation, coalesce(x, 0) AS expected, coalesce(y, 0) AS actual, coalesce(y, 0) - coalesce(x, 0) AS delta FROM (SELECT c_nationkey AS nation, count(*) AS x FROM customer GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS nation, count(*) AS y FROM supplier GROUP BY ALL) b ON a.nation = b.nation")
def a24_reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.reconciled(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


@query(f"WITH {EDGES} SELECT DISTINCT src, type, dst FROM e WHERE src IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 10) AND dst IN (SELECT 'r' || r_regionkey FROM region)")
def k8_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    nodes = table(spark, d, "nation").where("n_nationkey < 10").select(F.concat(F.lit("n"), "n_nationkey").alias("id")).unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")))
    return sinks.merge_edges(e.unionByName(e), nodes).select("src", "type", "dst")


@query("""SELECT 's' || s_suppkey AS src, CASE WHEN s_suppkey % 11 = 0 THEN 'ODD' ELSE 'OF' END AS type, CASE WHEN s_suppkey % 7 = 0 THEN 'x' || s_nationkey WHEN s_suppkey % 17 = 0 THEN 'o' || s_nationkey WHEN s_suppkey % 13 = 0 THEN 's' || s_suppkey ELSE 'n' || s_nationkey END AS dst,
concat_ws('; ', CASE WHEN s_suppkey % 11 = 0 THEN 'unknown type' END, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 17 = 0 THEN 'unknown kind' END, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown endpoint' END, CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey % 13 = 0 THEN 'type does not fit kinds' END, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey % 13 = 0 THEN 'self loop' END, CASE WHEN s_suppkey % 5 = 0 THEN 'no evidence' END) AS reasons FROM supplier""")
def f15_relation_validate(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-nation relations with planted faults."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    rel = s.select(F.concat(F.lit("s"), k).alias("src"), F.when(k % 11 == 0, "ODD").otherwise("OF").alias("type"), F.when(k % 7 == 0, F.concat(F.lit("x"), "s_nationkey")).when(k % 17 == 0, F.concat(F.lit("o"), "s_nationkey")).when(k % 13 == 0, F.concat(F.lit("s"), k)).otherwise(F.concat(F.lit("n"), "s_nationkey")).alias("dst"), F.when(k % 5 == 0, " ").otherwise("seen").alias("evidence"))
    nodes = s.select(F.concat(F.lit("s"), k).alias("id"), F.lit("supplier").alias("kind")).unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("kind")))
    nodes = nodes.unionByName(table(spark, d, "nation").select(F.concat(F.lit("o"), "n_nationkey").alias("id"), F.lit("other").alias("kind")))
    return graph.relation_faults(rel, nodes, {"OF": ("supplier", "nation")})


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT 'r' || r_regionkey AS node, 0 AS hops FROM region WHERE r_regionkey = 1 UNION SELECT b.dst, hops + 1 FROM t JOIN b ON node = b.src WHERE hops < 3)
SELECT node, min(hops) = 0 AS is_seed, min(hops) AS hops, round(pow(0.85, min(hops)), 6) AS score FROM t GROUP BY node""")
def o6_seed_precedence(spark: SparkSession, d: str) -> DataFrame:
    """One region and what three hops reach from it, each node once: a seed stays a seed, else the first hop counts."""
    seed = table(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    far = graph.distances(_edges(spark, d), seed, 3).select("node", "hops", F.round(F.pow(F.lit(0.85), F.col("hops")), 6).alias("score"))
    more = graph.hops(_edges(spark, d), seed, 2).select("node", "hops", "score")
    return graph.seeded(seed.select(F.col("id").alias("node"), F.lit(1.0).alias("score")), far.unionByName(more))


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every fourth order a document whose code its id gives; each cites three codes, one of them perhaps its own."""
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").where(k % 4 == 0).select(k.alias("doc_id"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), S.code_of(F.concat(F.lit("TT-"), k.cast("string"), F.lit("-2016-NHNN"))).alias("code"))
    text = F.concat(F.lit("Căn cứ Thông tư số "), (k % 40).cast("string"), F.lit("/2016/TT-NHNN; thay thế Nghị định số "), F.col("o_custkey").cast("string"), F.lit("/2019/NĐ-CP; căn cứ Luật số "), k.cast("string"), F.lit("/2016/TT-NHNN;"))
    pattern = F.lit(rf"(?iu)(thay thế|căn cứ) ([^;0-9]*)({S.CODE})")
    got = F.arrays_zip(*[F.regexp_extract_all("body", pattern, i).alias(n) for i, n in ((1, "relation"), (2, "title"), (3, "code"))])
    cited = table(spark, d, "orders").where(k % 4 == 0).select(k.alias("doc_id"), text.alias("body")).select("doc_id", F.inline(got))
    return graph.loaded(docs, cited.select("doc_id", F.when(F.lower("relation") == "căn cứ", "CAN_CU").otherwise("THAY_THE").alias("relation"), "code", F.trim("title").alias("title")))


CITED = """r AS (SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderkey AS title, o_orderkey || '/2016/TT-NHNN' AS code FROM orders WHERE o_orderkey % 4 = 0),
c AS (SELECT o_orderkey::VARCHAR AS src, 'CAN_CU' AS type, (o_orderkey % 40) || '/2016/TT-NHNN' AS code, 'Thông tư số' AS title FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'THAY_THE', o_custkey || '/2019/NĐ-CP', 'Nghị định số' FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey::VARCHAR, 'CAN_CU', o_orderkey || '/2016/TT-NHNN', 'Luật số' FROM orders WHERE o_orderkey % 4 = 0)"""


@query(f"WITH {CITED} SELECT id, title, code, true AS is_root FROM r UNION ALL SELECT code, min(c.title), code, false FROM c WHERE code NOT IN (SELECT code FROM r) GROUP BY code")
def z16_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Roots and placeholders of all documents' references."""
    return _loaded(spark, d)[0]


@query(f"WITH {CITED} SELECT DISTINCT src, type, coalesce(r.id, c.code) AS dst FROM c LEFT JOIN r USING (code) WHERE src <> coalesce(r.id, c.code)")
def z16_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d)[1]


@query(f"WITH {CITED}, e AS (SELECT DISTINCT src, type, coalesce(r.id, c.code) AS dst FROM c LEFT JOIN r USING (code) WHERE src <> coalesce(r.id, c.code)) SELECT 'node' AS part, is_root::VARCHAR AS kind, count(*) AS n FROM (SELECT true AS is_root FROM r UNION ALL SELECT false FROM (SELECT DISTINCT code FROM c WHERE code NOT IN (SELECT code FROM r))) GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY ALL")
def z16_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a load makes, by kind."""
    nodes, edges = _loaded(spark, d)
    return nodes.groupBy(F.lit("node").alias("part"), F.col("is_root").cast("string").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n")))


@query("SELECT 'customer' AS label, 'c_custkey' AS key, 0::BIGINT AS nulls, count(*) FILTER (n > 1) AS repeated FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey) UNION ALL SELECT 'orders', 'o_custkey', 0, count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) UNION ALL SELECT 'documents', 'md5', (SELECT count(*) FROM documents WHERE doc_id % 10 = 0), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 10 <> 0 GROUP BY md5(text))")
def k10_constraints(spark: SparkSession, d: str) -> DataFrame:
    """What uniqueness constraints would refuse."""
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.md5("text")).alias("md5"))
    return graph.constraint_faults({"customer": (table(spark, d, "customer"), "c_custkey"), "orders": (table(spark, d, "orders"), "o_custkey"), "documents": (docs, "md5")})


@query(f"WITH {EDGES}, n AS (SELECT 'n' || n_nationkey AS id, 'nation' AS label, n_name AS name FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier) SELECT id, name, count(edge) AS degree FROM n LEFT JOIN b ON b.src = id WHERE label = 'nation' AND contains(name, '1') GROUP BY ALL")
def s16_graph_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label and property, with the number of their edges."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("label"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("label"), F.col("s_name").alias("name"))
    nodes = n.unionByName(s).where("label = 'nation' and contains(name, '1')")
    return nodes.join(graph.undirected(_edges(spark, d)), nodes["id"] == F.col("src"), "left").groupBy("id", "name").agg(F.count("edge").alias("degree"))


@query("SELECT min(p_partkey) AS risk, arg_min(control, p_partkey) AS control, arg_min(event, p_partkey) AS event FROM (SELECT p_partkey, min(CASE WHEN l_returnflag = 'N' THEN l_suppkey END) AS control, min(CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS event FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey) WHERE control IS NOT NULL AND event IS NOT NULL")
def z17_example_path(spark: SparkSession, d: str) -> DataFrame:
    """The first part (a risk) with both a supplier (its control) and a returned order (its event)."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")  # noqa: E741
    ends = l.groupBy("l_partkey").agg(F.min(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("control"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("event"))
    return ends.where("control is not null and event is not null").agg(F.min("l_partkey").alias("risk"), F.min_by("control", "l_partkey").alias("control"), F.min_by("event", "l_partkey").alias("event"))


@query("SELECT conv_id || ':' || turn AS id, conv_id || ':' || min(turn) OVER (PARTITION BY conv_id) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS hops FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL)")
def j19_chain_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's distance from the head of its chain, by NEXT pointers."""
    turns = table(spark, d, "conversations").where("turn is not null and conv_id is not null").select("conv_id", "turn").distinct()
    at = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), c.cast("string"))
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    links = turns.select("conv_id", "turn", after.alias("after")).select(at(F.col("turn")).alias("id"), F.when(F.col("after").isNotNull(), at(F.col("after"))).alias("next_id"))
    return graph.chain(links, 1024).select("id", "head", "hops")


@query("SELECT 'v' || doc_id AS vector_id, doc_id AS node, kind, len(embedding)::INT AS dim FROM (SELECT doc_id, (['document', 'chapter', 'paragraph', 'list', 'table', 'article', 'subarticle'])[doc_id % 7 + 1] AS kind FROM documents) JOIN embeddings ON vec_id = doc_id WHERE kind IN ('paragraph', 'list', 'table', 'article', 'subarticle')")
def k9_vector_edges(spark: SparkSession, d: str) -> DataFrame:
    """A vector node and its HAS_VECTOR edge for nodes of leaf kinds that have a vector."""
    kinds = ["document", "chapter", "paragraph", "list", "table", "article", "subarticle"]
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 7).cast("int")).alias("kind"))
    out = sinks.vector_edges(nodes, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return out.select("vector_id", F.col("id").alias("node"), "kind", F.size("embedding").alias("dim"))


@query("SELECT scope, event_id FROM (SELECT 'label' AS scope, event_id FROM events WHERE event_type <> 'error' OR event_type IS NULL UNION ALL SELECT 'session', event_id FROM events WHERE user_id <> 7 OR user_id IS NULL)")
def k11_scoped_wipe(spark: SparkSession, d: str) -> DataFrame:
    """What wipes of a label, of a session and of all leave."""
    e = table(spark, d, "events")
    left = lambda name, df: df.select(F.lit(name).alias("scope"), "event_id")
    return left("label", sinks.wiped(e, "event_type", "error")).unionByName(left("session", sinks.wiped(e, "user_id", 7))).unionByName(left("all", sinks.wiped(e, "event_type")))


NAMED = "(['Luật các tổ chức tín dụng', 'Nghị định này', 'quy định tại khoản hai', 'Thông tư sửa đổi'])[p_partkey % 4 + 1] || ' ' || repeat(p_name || ' ', (p_partkey % 9)::INT)"


@query(f"SELECT p_partkey, title FROM (SELECT p_partkey, p_size, trim({NAMED}) AS title FROM part) WHERE NOT contains(title, 'này') AND (p_size % 3 = 0 OR regexp_matches(title, '^(Luật|Nghị định|Thông tư)') OR length(title) <= 60)")
def f18_reference_filter(spark: SparkSession, d: str) -> DataFrame:
    """References with a code, or with a document's kind in front, or short ones, but none that mean the document itself."""
    k = F.col("p_partkey")
    names = ["Luật các tổ chức tín dụng", "Nghị định này", "quy định tại khoản hai", "Thông tư sửa đổi"]
    title = F.trim(F.concat(F.get(F.array(*map(F.lit, names)), (k % 4).cast("int")), F.lit(" "), F.repeat(F.concat("p_name", F.lit(" ")), (k % 9).cast("int"))))
    rows = table(spark, d, "part").select(k, title.alias("title"), F.when(F.col("p_size") % 3 == 0, "1/2").alias("code"))
    return rows.where(S.reference_kept(F.col("title"), F.col("code"), ["này"], 60)).select("p_partkey", "title")


@query("SELECT key, canonical, forms FROM (SELECT lower(form) AS key, arg_max(form, (n, form)) AS canonical, string_agg(form, ' | ' ORDER BY form) AS forms FROM (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z]?[a-z]{6,}')) AS form FROM documents) GROUP BY form) GROUP BY lower(form)) WHERE contains(forms, ' | ') OR forms <> canonical")
def f23_alias_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entities with several names, or with one other than the canonical one."""
    g = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]?[a-z]{6,}"), 0)).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    e = g.groupBy(F.lower("form").alias("key")).agg(F.max(F.struct("n", "form"))["form"].alias("canonical"), F.array_join(F.array_sort(F.collect_set("form")), " | ").alias("forms"))
    return e.where(F.contains("forms", F.lit(" | ")) | (F.col("forms") != F.col("canonical")))


@query(f"""WITH RECURSIVE {EDGES}, v AS (SELECT 'n' || n_nationkey AS node, round(CASE WHEN n_nationkey % 2 = 0 THEN 0.85 ELSE 0.9 - n_nationkey / 100.0 END, 6) AS score FROM nation WHERE n_nationkey < 6),
t AS (SELECT node, node AS seed, 0 AS hops FROM v UNION SELECT b.dst, seed, hops + 1 FROM t JOIN b ON node = b.src WHERE hops < 2), h AS (SELECT node, min(hops) AS hops FROM t WHERE hops > 0 AND node <> seed GROUP BY node)
SELECT node, origin, score, row_number() OVER (ORDER BY score DESC, origin = 'vector' DESC, node) AS place FROM (SELECT node, 'vector' AS origin, score FROM v UNION ALL SELECT node, 'hop', round(pow(0.85, hops), 6) FROM h WHERE node NOT IN (SELECT node FROM v))""")
def t12_hop_order(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits and what two hops add to them, by score, at equal scores vector hits first."""
    k = F.col("n_nationkey")
    score = F.round(F.when(k % 2 == 0, F.lit(0.85)).otherwise(0.9 - k / 100.0), 6)
    seeds = table(spark, d, "nation").where(k < 6).select(F.concat(F.lit("n"), k).alias("node"), score.alias("score"))
    far = graph.distances(_edges(spark, d), seeds.select(F.col("node").alias("id")), 2).groupBy("node").agg(F.min("hops").alias("hops"))
    rows = graph.seeded(seeds, far.withColumn("score", F.round(F.pow(F.lit(0.85), F.col("hops")), 6)))
    out = rows.select("node", F.when(F.col("is_seed"), "vector").otherwise("hop").alias("origin"), "score")
    return search.numbered(out, [F.desc("score"), F.asc(F.when(F.col("origin") == "vector", 0).otherwise(1)), F.asc("node")], "place")

"""Text, reference, label and id functions over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions import text as X
from ..operators import chunking
from ..sources.tables import pages_of_markdown, table
from .registry import query


@query("SELECT doc_id::VARCHAR AS source, unnest([1, 2]) AS page, unnest([chr(10) || md5(text) || chr(10), chr(10) || source]) AS text FROM documents")
def s5_markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts with two page marks, one page a row."""
    made = F.concat(F.lit("Page 1\n"), F.md5("text"), F.lit("\n\n## Trang 2 of 2\n"), "source")
    return pages_of_markdown(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), made.alias("text"))).drop("warning")


@query("SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS md5 FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS t FROM documents)")
def x1_tokens_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.tokens_plain(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


@query(r"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[À-ỹA-Za-z0-9]+(?:[/\-.][À-ỹA-Za-z0-9]+)*') AS t FROM documents)")
def x2_tokens_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.tokens_codes(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


@query(r"SELECT item_id, array_to_string([x FOR x IN regexp_extract_all(lower(text), '[À-ỹA-Za-z0-9]+(?:[/\-.][À-ỹA-Za-z0-9]+)*') IF length(x) >= 2][1:5], ' ') AS tokens FROM benchmark")
def x3_graph_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.tokens_graph(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, md5(lower(translate('Điều ế ' || text, '{S.MARKED}', '{S.PLAIN}'))) AS md5 FROM documents")
def x7_fold_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(S.folded(F.concat(F.lit("Điều ế "), "text"))).alias("md5"))


@query("SELECT doc_id, md5(CASE WHEN s = '' THEN 'item' ELSE s END) AS slug FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)")
def x8_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.slug(F.col("text"))).alias("slug"))


LINES = "SELECT p_partkey, (['## Chương IV: ', '**Mục 2** ', 'Điều ', '', 'b) ', '__Chapter 3__ '])[p_partkey % 6 + 1] || p_partkey || '. ' || p_name AS line FROM part"


@query(rf"SELECT p_partkey, line, CASE WHEN regexp_matches(b, '^(?i:chương|chapter|phần) +[0-9IVXLC]+') THEN 'chapter' WHEN regexp_matches(b, '^(?i:mục|section) +[0-9IVXLC]+') THEN 'section' WHEN regexp_matches(b, '^(?i:điều|article) +[0-9]+') THEN 'article' WHEN regexp_matches(b, '^[0-9]+\. ') THEN 'clause' WHEN regexp_matches(b, '^[a-zđ]\) ') THEN 'point' END AS kind FROM (SELECT *, regexp_replace(line, '^[#*_ ]+|[#*_ ]+$', '', 'g') AS b FROM ({LINES}))")
def x14_heading(spark: SparkSession, d: str) -> DataFrame:
    starts = F.array(*map(F.lit, ["## Chương IV: ", "**Mục 2** ", "Điều ", "", "b) ", "__Chapter 3__ "]))
    line = F.concat(F.get(starts, (F.col("p_partkey") % 6).cast("int")), F.col("p_partkey").cast("string"), F.lit(". "), "p_name")
    return table(spark, d, "part").select("p_partkey", line.alias("line")).withColumn("kind", S.heading(F.col("line")))


@query("SELECT doc_id, unnest([0, 1, 2]) AS chunk, unnest(['', 'Điều 1.', 'Điều 2.']) AS marker, unnest(['on ' || md5(text) || chr(10), 'Điều 1. ' || source || chr(10), 'Điều 2. ' || lang]) AS text FROM documents")
def x18_article_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the first article, and each article."""
    made = F.concat(F.lit("on "), F.md5("text"), F.lit("\nĐiều 1. "), "source", F.lit("\nĐiều 2. "), "lang")
    return chunking.by_marker(table(spark, d, "documents").select("doc_id", made.alias("text")), r"Điều [0-9]+\.")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'thay thế' WHEN 1 THEN 'căn cứ' ELSE 'sửa đổi' END AS relation, o_orderkey || '/2016/TT-NHNN' AS code FROM orders UNION ALL SELECT o_orderkey, 'căn cứ', o_custkey || '/2019/NĐ-CP' FROM orders")
def x21_relationship_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each key word with the reference after it."""
    k = F.col("o_orderkey")
    made = F.concat(F.when(k % 3 == 0, "thay thế").when(k % 3 == 1, "căn cứ").otherwise("sửa đổi"), F.lit(" Thông tư số "), k, F.lit("/2016/TT-NHNN; căn cứ Nghị định "), "o_custkey", F.lit("/2019/NĐ-CP;"))
    pattern = F.lit(rf"(thay thế|căn cứ|sửa đổi) [^;0-9]*({S.CODE})")
    pairs = F.arrays_zip(F.regexp_extract_all("body", pattern, 1).alias("relation"), F.regexp_extract_all("body", pattern, 2).alias("code"))
    return table(spark, d, "orders").select(k, made.alias("body")).select(k, F.inline(pairs)).toDF("o_orderkey", "relation", "code")


REFERENCE = "SELECT o_orderkey, (['Thông tư', 'Nghị định', 'quyết định', 'Công văn'])[o_orderkey % 4 + 1] || ' số ' || o_orderkey || '/2016/' || (['TT-NHNN', 'NĐ-CP', 'X', 'Y'])[o_orderkey % 4 + 1] || ' ngày ' || (o_orderkey % 28 + 1) || ' tháng ' || (o_orderkey % 12 + 1) || ' năm 2016' AS ref FROM orders"


@query(f"SELECT o_orderkey, o_orderkey || '/2016/' || (['TT-NHNN', 'NĐ-CP', 'X', 'Y'])[o_orderkey % 4 + 1] AS code, printf('2016-%02d-%02d', o_orderkey % 12 + 1, o_orderkey % 28 + 1) AS date, (['Thông tư', 'Nghị định', 'Quyết định', NULL])[o_orderkey % 4 + 1] AS kind FROM ({REFERENCE})")
def x22_reference_split(spark: SparkSession, d: str) -> DataFrame:
    """Code, date and kind of a written reference."""
    k = F.col("o_orderkey")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % 4).cast("int"))
    ref = F.concat(pick("Thông tư", "Nghị định", "quyết định", "Công văn"), F.lit(" số "), k, F.lit("/2016/"), pick("TT-NHNN", "NĐ-CP", "X", "Y"), F.lit(" ngày "), k % 28 + 1, F.lit(" tháng "), k % 12 + 1, F.lit(" năm 2016"))
    code = F.regexp_extract("ref", S.CODE, 0)
    return table(spark, d, "orders").select(k, ref.alias("ref")).select(k, code.alias("code"), S.date_of(F.col("ref")).alias("date"), S.kind_of(code, F.col("ref")).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey || '/2016/TT-' || o_orderstatus END AS code FROM orders")
def x24_code_from_id(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = F.when(k % 5 > 0, F.concat(F.lit("TT-"), k, F.lit("-2016-"), "o_orderstatus")).otherwise(F.concat(F.lit("TT-"), k))
    return table(spark, d, "orders").select(k, S.code_of(made).alias("code"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct([regexp_replace(r, '\s+', ' ', 'g') FOR r IN regexp_extract_all(lower('Article  7, ' || text), '(?:điều|khoản|điểm|article|clause|point)\s+\w+|\b(?:19|20)\d{2}\b')])), ',') AS refs FROM documents")
def x25_legal_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = X.legal_refs(F.concat(F.lit("Article  7, "), "text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(refs), ",").alias("refs"))


@query(r"SELECT trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, min(item_id) AS item_id FROM benchmark GROUP BY 1")
def x26_query_key(spark: SparkSession, d: str) -> DataFrame:
    """One question for each key."""
    return table(spark, d, "benchmark").groupBy(S.query_key(F.col("text")).alias("key")).agg(F.min("item_id").alias("item_id"))


ANSWER = "SELECT o_orderkey, 'as [E' || o_orderkey % 4 || '] and  [E' || o_orderkey % 6 || '] say' AS answer FROM orders"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k, F.concat(F.lit("as [E"), k % 4, F.lit("] and  [E"), k % 6, F.lit("] say")).alias("answer"))


@query(f"SELECT o_orderkey, trim(regexp_replace(replace(replace(replace(replace(replace(replace(answer, '[E1]', '(doc 1)'), '[E2]', '(doc 2)'), '[E3]', '(doc 3)'), '[E0]', ''), '[E4]', ''), '[E5]', ''), ' +', ' ', 'g')) AS answer, len(list_distinct([x FOR x IN [o_orderkey % 4, o_orderkey % 6] IF x NOT IN (1, 2, 3)]))::INT AS warnings FROM ({ANSWER})")
def x27_citation_labels(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for i in (1, 2, 3) for x in (f"E{i}", f"(doc {i})")])
    return _answers(spark, d).select("o_orderkey", S.with_citations(F.col("answer"), known).alias("answer"), F.size(F.array_except(S.labels_in(F.col("answer")), F.map_keys(known))).alias("warnings"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 3 AND o_orderkey % 4 > 0 AND o_orderkey % 6 > 0 THEN answer ELSE '' END AS answer, CASE WHEN o_orderkey % 6 <= 3 AND o_orderkey % 4 > 0 AND o_orderkey % 6 > 0 THEN 'ok' ELSE 'citation_validation_failed' END AS status FROM ({ANSWER})")
def x28_citation_strict(spark: SparkSession, d: str) -> DataFrame:
    """An unknown label empties the answer."""
    labels = S.labels_in(F.col("answer"))
    wrong = F.size(F.array_except(labels, F.array(*map(F.lit, ("E1", "E2", "E3"))))) > 0
    status = F.when(wrong, "citation_validation_failed").when(F.size(labels) == 0, "no_citation").otherwise("ok")
    return _answers(spark, d).select("o_orderkey", F.when(wrong, "").otherwise(F.col("answer")).alias("answer"), status.alias("status"))


@query("SELECT conv_id, md5(string_agg('[E' || k || '] ' || role || ': ' || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY k)) AS md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE text IS NOT NULL) WHERE k <= 5 GROUP BY conv_id")
def x29_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The first five turns as numbered evidence, each cut at 2000 characters; turns are ranked before anything is gathered."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    kept = table(spark, d, "conversations").where("text is not null").withColumn("k", at).where("k <= 5")
    block = F.concat(F.lit("[E"), "k", F.lit("] "), "role", F.lit(": "), F.substring("text", 1, 2000))
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))).alias("bs")).select("conv_id", F.md5(F.array_join("bs.b", "\n\n")).alias("md5"))


@query("SELECT doc_id, md5('title: ' || lang || ' | ' || source || chr(10) || 'text: ' || text) AS passage, md5('task: search | query: ' || text) AS query FROM documents")
def x30_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """What a model is to be given: a breadcrumb and the body, or a prefixed query."""
    body = F.concat_ws("\n", F.concat(F.lit("title: "), F.concat_ws(" | ", "lang", "source")), F.concat(F.lit("text: "), "text"))
    return table(spark, d, "documents").select("doc_id", F.md5(body).alias("passage"), F.md5(F.concat(F.lit("task: search | query: "), "text")).alias("query"))


@query(r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '"' || replace(replace(props, '\', '\\'), '"', '\"') || '"' END AS scalar FROM events""")
def x32_yaml_scalar(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", S.yaml_scalar(c).alias("scalar"))


@query("SELECT s_suppkey, target, n_nationkey IS NULL AS broken FROM (SELECT s_suppkey, unnest(['n' || s_nationkey, 'n' || (s_nationkey + 20)]) AS target FROM supplier) LEFT JOIN nation ON target = 'n' || n_nationkey")
def x33_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page's text, joined to the pages that exist."""
    s = table(spark, d, "supplier")
    made = F.concat(F.lit("at [[n"), "s_nationkey", F.lit("|home]], near [[n"), F.col("s_nationkey") + 20, F.lit("]] and [[n"), "s_nationkey", F.lit("]]"))
    pages = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("page"))
    return s.select("s_suppkey", F.explode(S.wikilinks(made)).alias("target")).join(pages, F.col("target") == F.col("page"), "left").select("s_suppkey", "target", F.col("page").isNull().alias("broken"))


@query("SELECT p_partkey, trim(x) AS entity FROM (SELECT p_partkey, unnest(string_split(p_brand || ', ,' || p_type, ',')) AS x FROM part) WHERE trim(x) <> ''")
def x36_comma_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat("p_brand", F.lit(", ,"), "p_type"), ",")).alias("x")).select("p_partkey", F.trim("x").alias("entity")).where("entity <> ''")


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS score FROM events")
def y1_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(X.sigmoid(F.col("value") / 100), 6).alias("score"))


@query("SELECT vec_id, round(list_cosine_similarity(e, list_reverse(e)), 5) AS cosine, round(list_inner_product(e, list_reverse(e)), 5) AS dot FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def y2_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and dot product of each vector with itself reversed."""
    e, back = F.col("embedding"), F.reverse("embedding")
    dot = F.aggregate(F.zip_with(e, back, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return table(spark, d, "embeddings").select("vec_id", F.round(X.cosine(e, back), 5).alias("cosine"), F.round(dot, 5).alias("dot"))


@query("SELECT l_orderkey, l_linenumber, round(pow(0.85, l_linenumber), 6) AS decayed, round(1 / log2(l_linenumber + 1), 6) AS discount FROM lineitem")
def y4_decay_and_discount(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", n, F.round(F.pow(F.lit(0.85), n), 6).alias("decayed"), F.round(1 / F.log2(n + 1), 6).alias("discount"))


@query(f"SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4 + 1)::BIGINT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT o_orderkey, sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode(o_orderkey::VARCHAR)) AS h FROM orders)")
def y8_uuid5(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids; a test holds them against the standard library."""
    return table(spark, d, "orders").select("o_orderkey", S.uuid5(F.col("o_orderkey").cast("string")).alias("uuid"))


@query("SELECT doc_id, substr(sha256(source), 1, 16) || ':' || printf('%03d', doc_id % 1000) AS parent_id, 'store_' || substr(sha256(lang), 1, 10) AS store, md5(doc_id::VARCHAR) AS signature FROM documents")
def y9_hashed_ids(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda c, n: F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, n)
    return table(spark, d, "documents").select("doc_id", F.concat(hashed("source", 16), F.lit(":"), F.format_string("%03d", F.col("doc_id") % 1000)).alias("parent_id"), F.concat(F.lit("store_"), hashed("lang", 10)).alias("store"), F.md5(F.col("doc_id").cast("string")).alias("signature"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'llm-unavailable' WHEN 1 THEN 'no-context' WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'partial' ELSE 'no-graph-data' END WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 'answered' ELSE 'no-graph-data' END ELSE 'no-context' END AS verdict FROM orders")
def x35_answer_judge(spark: SparkSession, d: str) -> DataFrame:
    """Five answers, of which every second question had chunks."""
    answers = ["[LLM unavailable: quota]", "Không có thông tin về việc này.", "Có.", "Ngân hàng phải lập báo cáo theo quy định tại điều 5 và gửi trước ngày 15 hằng tháng.", "Ngữ cảnh không nói tới."]
    said = F.get(F.array(*map(F.lit, answers)), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.judged(said, F.col("o_custkey") % 2 == 0).alias("verdict"))

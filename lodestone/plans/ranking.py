"""Search, fusion, gates and retrieval metrics over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import access, search
from ..sources.tables import table
from .registry import query

QUESTION = "that and the thand erthe inand"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _question(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(QUESTION).alias("text"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: all benchmark items."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25_sql(tokens: str, queries: str, where: str = "") -> str:
    cut = lambda c: tokens.replace("$", c)
    return f"""
d AS (SELECT doc_id, {cut("text")} AS ts FROM documents {where}), q AS ({queries}),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, s),
w AS (SELECT query_id, q2.term, times * CASE WHEN idf < 0 THEN (SELECT 0.25 * avg(idf) FROM idf) ELSE idf END AS w
  FROM (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({cut("text")}) AS term FROM q) GROUP BY ALL) q2 JOIN idf USING (term)),
scored AS (SELECT query_id, doc_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN w USING (term), s GROUP BY ALL)"""


PLAIN, CODES = r"regexp_extract_all(replace(lower($), 'ß', 'ss'), '[\p{L}\p{N}]+')", r"regexp_extract_all(lower($), '[À-ỹA-Za-z0-9]+(?:[/\-\.][À-ỹA-Za-z0-9]+)*')"
ONE = f"SELECT 0::BIGINT AS query_id, '{QUESTION}' AS text"
ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
TOP = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}"


def _top(scored: DataFrame, k: int) -> DataFrame:
    return search.top(scored.withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.asc("doc_id")], ["query_id"])


@query(f"WITH {_bm25_sql(PLAIN, ONE)}, kept AS (SELECT 0::BIGINT AS query_id, d.doc_id, coalesce(score, 0) AS score FROM d LEFT JOIN scored USING (doc_id)) " + TOP.format(k=10).replace("scored", "kept"))
def t1_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Lexical top ten, documents without any term kept at zero."""
    corpus, asked = _corpus(spark, d), _question(spark)
    scored = corpus.select("doc_id").join(search.bm25(corpus, asked).select("doc_id", "score"), "doc_id", "left")
    return _top(scored.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.coalesce("score", F.lit(0.0)).alias("score")), 10)


@query(f"WITH {_bm25_sql(CODES, ITEMS)} " + TOP.format(k=10).replace("FROM scored", "FROM scored WHERE round(score, 6) > 0"))
def t2_bm25_topk_codes(spark: SparkSession, d: str) -> DataFrame:
    """Lexical top ten of several questions, with codes kept whole and zero scores dropped."""
    return _top(search.bm25(_corpus(spark, d), _items(spark, d), X.tokens_codes).where(F.round("score", 6) > 0), 10)


def _queries_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


DENSE = """dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id))"""


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dense WHERE rank <= 5")
def t3_dense_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine, the five nearest of each query vector."""
    vectors = table(spark, d, "embeddings")
    return search.dense(vectors, _queries_of(vectors), 5)


def _branches(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two lexical branches under different tokens, and one by length, all over the same questions."""
    corpus, asked = _corpus(spark, d), _items(spark, d)
    return {"plain": _top(search.bm25(corpus, asked), 20), "codes": _top(search.bm25(corpus, asked, X.tokens_codes), 10)}


B2 = f"WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=20)}), b AS (WITH {_bm25_sql(CODES, ITEMS)} {TOP.format(k=10)}), u AS (SELECT query_id, doc_id, rank AS plain_rank, NULL::BIGINT AS codes_rank FROM a UNION ALL SELECT query_id, doc_id, NULL, rank FROM b), "
FUSED = "m AS (SELECT query_id, doc_id, max(plain_rank) AS plain_rank, max(codes_rank) AS codes_rank FROM u GROUP BY ALL), f AS (SELECT *, round(coalesce({x}::DOUBLE / (60 + plain_rank), 0) + coalesce({y}::DOUBLE / (60 + codes_rank), 0), 9) AS score FROM m), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(coalesce(plain_rank, 1000000000), coalesce(codes_rank, 1000000000)), doc_id) AS fused_rank FROM f)"


@query(B2 + FUSED.format(x=1, y=1) + " SELECT query_id, doc_id, plain_rank, codes_rank, score, fused_rank FROM z")
def a7_rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf(_branches(spark, d))


@query(B2 + FUSED.format(x=0.5, y=2) + " SELECT query_id, doc_id, plain_rank, codes_rank, score, fused_rank FROM z")
def a6_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf(_branches(spark, d), weights={"plain": 0.5, "codes": 2.0})


@query(f"""WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=12)}), w AS (SELECT query_id, rank, doc_id, CASE WHEN query_id = 0 THEN 1.5 ELSE 1.0 END AS w FROM a),
g AS (SELECT doc_id, round(sum(w::DOUBLE / (60 + rank)), 9) AS score, count(DISTINCT query_id) AS support, min(rank) AS best_rank, string_agg(query_id::VARCHAR, ',' ORDER BY query_id::VARCHAR) AS supports FROM w GROUP BY doc_id)
SELECT *, row_number() OVER (ORDER BY score DESC, support DESC, best_rank, doc_id) AS rank FROM g""")
def a8_rrf_cross_query(spark: SparkSession, d: str) -> DataFrame:
    """Children over all questions as variants of one; the first weighs 1.5."""
    asked = _items(spark, d)
    weights = asked.select("query_id", F.when(F.col("query_id") == 0, 1.5).otherwise(1.0).alias("w"))
    return search.cross_query(_top(search.bm25(_corpus(spark, d), asked), 12), weights)


@query(f"""WITH a AS (WITH {_bm25_sql(PLAIN, ONE)} {TOP.format(k=200)}), c AS (SELECT a.doc_id, rank, source AS parent_id, row_number() OVER (PARTITION BY source ORDER BY rank, a.doc_id) AS rn FROM a JOIN documents USING (doc_id)),
g AS (SELECT parent_id, round(sum(CASE WHEN rn <= 3 THEN 1.0::DOUBLE / (60 + rank) END), 9) AS score, min(rank) AS best_child_rank, count(*) AS children, arg_min(doc_id, rn) AS anchor FROM c GROUP BY parent_id)
SELECT *, row_number() OVER (ORDER BY score DESC, best_child_rank, parent_id) AS rank FROM g""")
def a9_parent_rrf_capped(spark: SparkSession, d: str) -> DataFrame:
    """Sources as parents of the two hundred best documents; three children each count."""
    best = _top(search.bm25(_corpus(spark, d), _question(spark)), 200)
    return search.parents(best.join(table(spark, d, "documents").select("doc_id", F.col("source").alias("parent_id")), "doc_id"), 3)


@query(f"""WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=20)}), g AS (SELECT query_id, list({{'kept': [rank], 'used': n_chars}} ORDER BY rank) AS xs FROM a JOIN documents USING (doc_id) GROUP BY query_id),
f AS (SELECT query_id, list_reduce(xs, lambda s, x: CASE WHEN s.used + x.used <= 16000 THEN {{'kept': list_append(s.kept, x.kept[1]), 'used': s.used + x.used}} ELSE s END) AS r FROM g) SELECT query_id, r.used AS used, array_to_string(r.kept, ',') AS kept FROM f""")
def w6_context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best documents of each question under a budget of 16000 characters, skipping what doesn't fit."""
    hits = _top(search.bm25(_corpus(spark, d), _items(spark, d)), 20)
    return search.within_budget(hits.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "query_id", "rank", "n_chars", 16_000)


@query(f"WITH {DENSE} SELECT query_id, vec_id, rank, distance, accepted, CASE WHEN accepted THEN 'E' || row_number() OVER (PARTITION BY query_id, accepted ORDER BY rank) END AS label FROM (SELECT query_id, vec_id, rank, round(1 - score, 6) AS distance, round(1 - score, 6) <= 0.8 AS accepted FROM dense WHERE rank <= 10)")
def f6_gate_by_mode(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    hits = search.dense(vectors, _queries_of(vectors), 10).select("query_id", "vec_id", "rank", F.round(1 - F.col("score"), 6).alias("distance"))
    return search.gate(hits, "semantic", 0.8, 0.5)


@query(f"""WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=20)}), r AS (SELECT a.*, round(1 / (1 + exp(-(n_chars % 7 - 3)::DOUBLE)), 6) AS rerank_score FROM a JOIN documents USING (doc_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id) AS new_rank FROM r)
SELECT query_id, doc_id, score, rank, rerank_score, new_rank, rank - new_rank AS change FROM z WHERE new_rank <= 5""")
def t8_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic stand-in scores the candidates (length modulo 7)."""
    hits = _top(search.bm25(_corpus(spark, d), _items(spark, d)), 20).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return search.rerank(hits, F.col("n_chars") % 7 - 3, 5).drop("n_chars")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, rank of each hit, relevant): a hit is relevant if it holds the question's text."""
    docs, items = _corpus(spark, d), _items(spark, d)
    hits = _top(search.bm25(docs, items), 10)
    return hits.join(docs.withColumnRenamed("text", "body"), "doc_id").join(items, "query_id").select("query_id", "doc_id", "rank", F.contains("body", F.col("text")).alias("relevant"))


GRADED = f"WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=10)}), g AS (SELECT a.query_id, a.doc_id, a.rank, contains(d.text, b.text) AS relevant FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = a.query_id), "


@query(GRADED + """f AS (SELECT query_id, query_id % 2 AS kind, min(CASE WHEN relevant THEN rank END) AS first FROM g GROUP BY ALL)
SELECT coalesce(kind::VARCHAR, 'all') AS kind, count(*) AS n, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS hit1, round(avg((coalesce(first, 99) <= 3)::INT), 6) AS hit3, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f GROUP BY GROUPING SETS ((kind), ())""")
def a15_eval_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Hit@k and MRR by kind of question and over all, in one aggregation."""
    first = _graded(spark, d).groupBy("query_id", (F.col("query_id") % 2).alias("kind")).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    hit = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6).alias(f"hit{k}")
    return first.rollup("kind").agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr")).withColumn("kind", F.coalesce(F.col("kind").cast("string"), F.lit("all")))


@query(GRADED + """r AS (SELECT b.item_id AS query_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
h AS (SELECT query_id, count(*) FILTER (relevant) AS k, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) END) AS dcg, min(CASE WHEN relevant THEN rank END) AS first FROM g GROUP BY ALL)
SELECT r.query_id, r.n AS n_relevant, round(coalesce(k, 0)::DOUBLE / r.n, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(r.n, 10) + 1)]), 6) AS ndcg FROM r LEFT JOIN h USING (query_id)""")
def a16_eval_recall_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Recall, MRR and nDCG at ten against all documents that hold the question's text."""
    docs, items = _corpus(spark, d), _items(spark, d)
    gold = search.texts_holding(docs, items).groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = _graded(spark, d).groupBy("query_id").agg(F.count_if("relevant").alias("k"), F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return gold.join(got, "query_id", "left").select("query_id", "n_relevant", F.round(F.coalesce("k", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


@query(B2 + "m AS (SELECT query_id, doc_id, max(plain_rank) AS plain, max(codes_rank) AS codes FROM u GROUP BY ALL) SELECT query_id, doc_id, plain, codes, greatest(plain, codes) - least(plain, codes) AS movement FROM m")
def a29_mode_movement(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by mode, pivoted, and how far they are apart."""
    rows = None
    for name, df in _branches(spark, d).items():
        part = df.select("query_id", "doc_id", F.lit(name).alias("mode"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "doc_id").pivot("mode", ["plain", "codes"]).agg(F.max("rank")).withColumn("movement", F.greatest("plain", "codes") - F.least("plain", "codes"))


@query(B2 + "m AS (SELECT query_id, doc_id, count(plain_rank) AS p, count(codes_rank) AS c FROM u GROUP BY ALL) SELECT query_id, count(*) AS in_any, count(*) FILTER (p > 0 AND c > 0) AS in_both, count(*) FILTER (c = 0) AS only_plain, count(*) FILTER (p = 0) AS only_codes FROM m GROUP BY ALL")
def o3_candidate_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = search.rrf(_branches(spark, d))
    return b.groupBy("query_id").agg(F.count("*").alias("in_any"), F.count_if(F.col("plain_rank").isNotNull() & F.col("codes_rank").isNotNull()).alias("in_both"), F.count_if(F.col("codes_rank").isNull()).alias("only_plain"), F.count_if(F.col("plain_rank").isNull()).alias("only_codes"))


@query(f"WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=5)}) SELECT doc_id, count(*) AS n_queries, string_agg(query_id || ':' || rank, ',' ORDER BY query_id) AS ranks FROM a GROUP BY doc_id")
def a30_query_child_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix: each document that any item finds, with the items that find it as item:rank."""
    hits = _top(search.bm25(_corpus(spark, d), _items(spark, d)), 5)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "rank"))), lambda x: F.concat_ws(":", x["query_id"].cast("string"), x["rank"].cast("string")))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_queries"), F.array_join(cells, ",").alias("ranks"))


PREFIXES, WORDS = {"HR": "src1"}, {"HR": ["password"], "Risk": ["token", "secret"]}
ROLES = {"HR": ["Admin", "HR_Manager"], "Risk": ["Admin", "Risk_Officer"], "General": ["Admin", "HR_Manager", "Risk_Officer", "Employee"]}


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    label = access.classify(F.col("source"), F.col("text"), PREFIXES, WORDS)
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in ROLES.items() for x in pair])
    return docs.withColumn("label", label).withColumn("allowed_roles", F.element_at(allowed, F.col("label")))


LABEL = "CASE WHEN starts_with(source, 'src1') OR contains(lower(text), 'password') THEN 'HR' WHEN contains(lower(text), 'token') OR contains(lower(text), 'secret') THEN 'Risk' ELSE 'General' END"


@query(f"SELECT doc_id, {LABEL} AS label FROM documents")
def f12_rbac_classify(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("doc_id", "label")


@query(f"""WITH t AS (SELECT lang || '/' || source AS doc, {LABEL} AS label FROM documents), r AS (SELECT doc, unnest(CASE label WHEN 'HR' THEN ['Admin','HR_Manager'] WHEN 'Risk' THEN ['Admin','Risk_Officer'] ELSE ['Admin','HR_Manager','Risk_Officer','Employee'] END) AS role FROM t),
n AS (SELECT doc, count(*) AS n FROM t GROUP BY doc), k AS (SELECT doc, role, count(*) AS k FROM r GROUP BY ALL)
SELECT n.doc, coalesce(string_agg(role, ',' ORDER BY role) FILTER (k = n), 'Admin') AS roles FROM n LEFT JOIN k USING (doc) GROUP BY n.doc""")
def a11_rbac_group_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Roles that every chunk of a document allows; language and source stand for the document."""
    rows = _tagged(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("doc", F.concat_ws("/", "lang", "source"))
    return access.group_roles(rows, "doc")


@query(f"WITH {_bm25_sql(PLAIN, ONE, f'WHERE ({LABEL}) = {chr(39)}General{chr(39)}')} " + TOP.format(k=10))
def f8_rbac_prefilter_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Search of an employee: rows are filtered before any statistic is computed."""
    seen = access.permitted(_tagged(spark, d), ["Employee"])
    return _top(search.bm25(seen.select("doc_id", "text"), _question(spark)), 10)


@query(f"""WITH a AS (WITH {_bm25_sql(PLAIN, ITEMS)} {TOP.format(k=10)}), t AS (SELECT query_id, doc_id AS target FROM a WHERE rank = 1),
u AS (SELECT query_id, doc_id, (label = 'General') AS open FROM a JOIN (SELECT doc_id, {LABEL} AS label FROM documents) USING (doc_id))
SELECT t.query_id AS case_id, count(*) FILTER (u.doc_id = target AND open) AS leaks, count(*) FILTER (u.doc_id = target) AS found, CASE WHEN count(*) FILTER (u.doc_id = target AND open) > 0 THEN 'FAIL' WHEN count(*) FILTER (u.doc_id = target) = 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM t JOIN u USING (query_id) GROUP BY ALL""")
def a28_rbac_leak_audit(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each question is its target; an employee's run must not show it."""
    hits = _top(search.bm25(_corpus(spark, d), _items(spark, d)), 10).join(_tagged(spark, d).select("doc_id", "allowed_roles"), "doc_id")
    runs = hits.select(F.col("query_id").alias("case_id"), F.lit(True).alias("authorized"), "doc_id", "score").unionByName(access.permitted(hits, ["Employee"]).select(F.col("query_id").alias("case_id"), F.lit(False).alias("authorized"), "doc_id", "score"))
    return access.leak_audit(runs, hits.where("rank = 1").select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("target")))

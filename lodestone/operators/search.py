"""Ranked search: BM25, exact cosine, reciprocal-rank fusion, parents, budgets, gates and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import settled
from . import access


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def numbered(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Ranks over a whole result, 1 on, without one task for all: rows are dealt to ranges of the order and settled, each range is numbered
    by itself, and what the ranges before it hold is added; the counts, one row a range, are all that is gathered."""
    dealt = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_range", "_own", "_before")


def top(df: DataFrame, k: int, order: list[Column], by: list[str], name: str = "rank") -> DataFrame:
    """The k first of each group, ranked; Spark prunes groups before they are shuffled (WindowGroupLimit)."""
    return ranked(df, order, by, name).where(F.col(name) <= k)


COUNTED = "\0"  # stands for a document itself among its terms; no tokenizer yields it


def bm25(corpus: DataFrame, queries: DataFrame, tokenizer: Callable[[Column], Column] = X.tokens_plain, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(doc_id, text) x (query_id, text) to (query_id, doc_id, score) of the documents that hold a query term.

    Statistics cover the corpus as given: filter by role before calling, not after; a null text is an empty document.  Terms of negative
    idf get epsilon times the mean idf.  One pass counts, by term, documents and (under COUNTED) all documents with their lengths; its
    shuffle serves the mean, the statistics and the weights.  A second pass keeps the query terms of each document.
    """
    docs = corpus.select("doc_id", F.coalesce(tokenizer(F.col("text")), F.array().cast("array<string>")).alias("ts"))
    counted = docs.select(F.size("ts").alias("dl"), F.explode(F.array_append(F.array_distinct("ts"), F.lit(COUNTED))).alias("term"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dls"))
    whole = F.col("term") == COUNTED
    n, total = F.max(F.when(whole, F.col("df"))), F.max(F.when(whole, F.col("dls")))
    # The mean idf, log(n - df + 0.5) - log(df + 0.5), needs n first; rows by df are few.
    by_df = df.groupBy(F.when(whole, -1).otherwise(F.col("df")).alias("df")).agg(F.count("*").alias("terms"), n.alias("n"), total.alias("total"))
    stats = by_df.agg(F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("avgdl"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = by_df.drop("n").crossJoin(F.broadcast(stats)).where("df >= 0").agg((F.sum(F.col("terms") * idf) / F.sum("terms") * epsilon).alias("floor"))
    stats = stats.crossJoin(F.broadcast(mean))  # one row each
    asked = queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf)
    weights = weights.select("query_id", "term", "avgdl", (F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")) * F.col("times")).alias("w"))
    held = docs.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    held = held.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return held.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


QUERIES = 4096  # query vectors that are sent to the tasks at once


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, self_too: bool) -> Iterator[pa.RecordBatch]:
    """Of each batch the rows that may be among a query's k nearest: those no worse than its k-th there."""
    for b in batches:
        if not len(b):
            continue
        own, score = b.column(0).to_numpy(), np.round(_unit(_matrix(b.column(1))) @ q.T, 6)
        if not self_too:
            score[own[:, None] == ids[None, :]] = -np.inf
        least = np.partition(score, max(0, len(own) - k), axis=0)[max(0, len(own) - k)]
        i, j = np.nonzero((score >= least) & (score > -np.inf))
        yield pa.RecordBatch.from_pydict({"query_id": ids[j], "vec_id": own[i], "score": score[i, j]})


def dense(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERIES, self_too: bool = False) -> DataFrame:
    """(vec_id, embedding) against a stated set of query vectors (query_id, q): the k nearest others of each, by exact cosine.

    Queries are sent in blocks of about `block`, so what is broadcast has a bound at any number of them; a task multiplies its batches
    with a block and hands on what may be nearest.  Null vectors are left out."""
    asked, n = queries.where("q is not null"), queries.count()
    many, out = max(1, -(-n // block)), None
    for part in range(many):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == part) if many > 1 else asked).collect()
        if not rows:
            continue
        ids, q = np.array([r.query_id for r in rows], np.int64), _unit(np.array([r.q for r in rows], np.float64))
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))
        scored = vectors.where("embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(lambda bs, sent=sent: _nearest(bs, *sent.value, k, self_too), "query_id long, vec_id long, score double")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return top(out, k, [F.desc("score"), F.asc("vec_id")], ["query_id"])


def texts_holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (query_id, text) to the pairs (query_id, doc_id) of which the document's text holds the item's.

    An inner word of the item is a whole word wherever the item stands, so documents are found by an equal word, the longest inner one,
    and only those are searched.  Items without an inner word are found by the documents' substrings of their length."""
    words = X.tokens_plain(F.col("text"))
    keyed = items.where("text is not null and text <> ''").select("query_id", F.col("text").alias("item"), F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("inner"))
    longest = F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))
    by_word = keyed.where("size(inner) > 0").select("query_id", "item", longest["word"].alias("word"))
    found = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(by_word.select("word", "query_id"), "word").select("doc_id", "query_id")
    long = found.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(by_word.select("query_id", "item"), "query_id").where(F.contains("body", F.col("item"))).select("query_id", "doc_id")
    short = keyed.where("size(inner) = 0").select("query_id", "item", F.length("item").alias("n"))
    sizes = short.agg(F.collect_set("n").alias("ns"))  # lengths below a few words: few
    parts = docs.crossJoin(F.broadcast(sizes)).select("doc_id", "text", F.explode("ns").alias("n")).where(F.length("text") >= F.col("n"))
    parts = parts.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substring("text", i, F.col("n"))))).alias("item"))
    return long.unionByName(parts.join(short.select("item", "query_id"), "item").select("query_id", "doc_id")).distinct()


def rrf(branches: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Branches of (query_id, doc_id, rank) to one row a hit with its ranks and fused score; one shuffle for any number of branches."""
    w = weights or {}
    rows = None
    for name, df in branches.items():
        part = df.select("query_id", "doc_id", F.lit(name).alias("branch"), "rank", (F.lit(float(w.get(name, 1.0))) / (k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.max(F.when(F.col("branch") == n, F.col("rank"))).alias(f"{n}_rank") for n in branches]
    fused = rows.groupBy("query_id", "doc_id").agg(*ranks, F.round(F.sum("s"), 9).alias("score"))
    best = F.least(*[F.coalesce(f"{n}_rank", F.lit(10**9)) for n in branches])
    return ranked(fused, [F.desc("score"), best, F.asc("doc_id")], ["query_id"], "fused_rank")


def cross_query(hits: DataFrame, weights: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, rank) of query variants with (query_id, w) to one ranking of children."""
    joined = hits.join(weights, "query_id")
    out = joined.groupBy("doc_id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("score"), F.countDistinct("query_id").alias("support"), F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set(F.col("query_id").cast("string"))), ",").alias("supports"))
    return numbered(out, [F.desc("score"), F.desc("support"), F.asc("best_rank"), F.asc("doc_id")])


def parents(children: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """(doc_id, parent_id, rank): a parent scores by its best `limit` children."""
    best = ranked(children, [F.asc("rank"), F.asc("doc_id")], ["parent_id"], "rn")
    out = best.groupBy("parent_id").agg(F.round(F.sum(F.when(F.col("rn") <= limit, 1.0 / (k + F.col("rank")))), 9).alias("score"), F.min("rank").alias("best_child_rank"), F.count("*").alias("children"), F.min_by("doc_id", "rn").alias("anchor"))
    return numbered(out, [F.desc("score"), F.asc("best_child_rank"), F.asc("parent_id")])


def within_budget(items: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy: in order, take what still fits; the first is always taken.  The items of one group are a ranking's head, bounded by its limit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    row = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n")))).alias("xs"))
    step = lambda a, x: F.when((F.size(a.kept) == 0) | (a.used + x.n <= budget), F.struct((a.used + x.n).alias("used"), F.array_append(a.kept, x.o).alias("kept"))).otherwise(a)
    return row.select(by, F.aggregate("xs", start, step).alias("r")).select(by, F.col("r.used").alias("used"), F.array_join(F.transform("r.kept", lambda v: v.cast("string")), ",").alias("kept"))


def gate(hits: DataFrame, mode: str, max_distance: float, min_rerank: float) -> DataFrame:
    """accepted, and labels E1.. numbered over the accepted only; a missing measure isn't accepted."""
    passed = (F.col("rerank_score") >= min_rerank) if mode == "hybrid_rerank" else (F.col("distance") <= max_distance)
    out = hits.withColumn("accepted", F.coalesce(passed, F.lit(False)))
    w = Window.partitionBy("query_id", "accepted").orderBy("rank")
    return out.withColumn("label", F.when(F.col("accepted"), F.concat(F.lit("E"), F.row_number().over(w))))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """By sigmoid of a scorer's column; ties by the rank before."""
    out = hits.withColumn("rerank_score", F.round(X.sigmoid(score), 6))
    out = ranked(out, [F.desc("rerank_score"), F.asc("rank"), F.asc("doc_id")], ["query_id"], "new_rank")
    return out.withColumn("change", F.col("rank") - F.col("new_rank")).where(F.col("new_rank") <= k)


def rerank_raw(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """By a scorer's raw column alone; the rank before settles ties."""
    out = ranked(hits.withColumn("rerank_score", score), [F.desc("rerank_score"), F.asc("rank")], ["query_id"], "new_rank")
    return out.where(F.col("new_rank") <= k)


def embedded(chunks: DataFrame, embed: Callable[[pd.Series], pd.Series], dim: int, text: str = "text") -> DataFrame:
    """chunks with an embedding by a model of the caller's, a batch of texts at a time, and what is wrong with each vector."""

    def model(texts: pd.Series) -> pd.Series:
        return embed(texts)

    out = chunks.withColumn("embedding", F.pandas_udf(model, "array<double>")(F.coalesce(text, F.lit(""))))
    return out.withColumn("faults", X.vector_faults(F.col("embedding"), dim))


METHODS = ("bm25", "dense", "hybrid", "hybrid_rerank")


class Retriever:
    """The search methods over one corpus: (doc_id, text), vectors (vec_id, embedding) of the same ids, and questions (query_id, text, q).

    With roles, corpus and vectors are first cut down to the documents whose allowed_roles meet them, so that neither statistics nor
    neighbours see others; known: canonical names by name, of which one at least has to be given."""

    def __init__(self, corpus: DataFrame, vectors: DataFrame, scorer: Column | None = None, roles: list[str] | None = None, known: dict[str, str] | None = None):
        if roles is not None:
            corpus = access.permitted(corpus, access.roles_known(roles, known or {r: r for r in roles}))
            vectors = vectors.join(corpus.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        self.corpus, self.vectors, self.scorer = corpus, vectors, scorer

    def bm25(self, questions: DataFrame, k: int) -> DataFrame:
        scored = bm25(self.corpus.select("doc_id", "text"), questions).withColumn("score", F.round("score", 6))
        return top(scored, k, [F.desc("score"), F.asc("doc_id")], ["query_id"])

    def dense(self, questions: DataFrame, k: int) -> DataFrame:
        return dense(self.vectors, questions.select("query_id", "q"), k, self_too=True).withColumnRenamed("vec_id", "doc_id")

    def hybrid(self, questions: DataFrame, k: int, candidates: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
        """Both branches fused; bm25_rank and dense_rank are the trace."""
        fused = rrf({"bm25": self.bm25(questions, candidates), "dense": self.dense(questions, candidates)}, weights=weights)
        return fused.withColumnRenamed("fused_rank", "rank").where(F.col("rank") <= k)

    def hybrid_rerank(self, questions: DataFrame, k: int, candidates: int = 20) -> DataFrame:
        if self.scorer is None:
            raise ValueError("reranker_unavailable")
        hits = self.hybrid(questions, candidates, candidates).join(self.corpus, "doc_id")
        return rerank(hits, self.scorer, k).select("query_id", "doc_id", F.col("rerank_score").alias("score"), F.col("rank").alias("hybrid_rank"), F.col("new_rank").alias("rank"), "change")

    def retrieve(self, method: str, questions: DataFrame, k: int = 5) -> DataFrame:
        """(method, query_id, rank, doc_id, score, note) by one of METHODS; a blank question has one row with a note."""
        name = method.strip().lower()
        if name not in METHODS:
            raise ValueError(f"{method!r} is none of {METHODS}")
        blank = F.trim(F.coalesce("text", F.lit(""))) == ""
        hits = getattr(self, name)(questions.where(~blank), k)
        none = [F.lit(None).cast(t).alias(n) for n, t in (("rank", "int"), ("doc_id", "bigint"), ("score", "double"))]
        rows = hits.select(F.lit(name).alias("method"), "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", F.lit(None).cast("string").alias("note"))
        return rows.unionByName(questions.where(blank).select(F.lit(name).alias("method"), "query_id", *none, F.lit("empty query").alias("note")))

"""Property graphs as node and edge tables: bounded trails, shortest paths, reconciliation, relation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "type", F.concat_ws("|", "src", "type", "dst").alias("edge"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "edge"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = 0.85) -> DataFrame:
    """Trails of at most `depth` edges, none twice, that end elsewhere than they began; one join a level."""
    both = undirected(edges)
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array().cast("array<string>").alias("used"), F.array("id").alias("path"))
    out = None
    for k in range(1, depth + 1):
        front = front.join(both, front["node"] == both["src"]).where(~F.array_contains("used", F.col("edge"))).select("seed", F.col("dst").alias("node"), F.array_append("used", F.col("edge")).alias("used"), F.array_append("path", F.col("dst")).alias("path"))
        found = front.where("node <> seed").select("seed", "node", F.lit(k).alias("hops"), F.array_join("path", ">").alias("path"), F.round(F.pow(F.lit(decay), F.lit(k)), 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Least number of edges from each seed to each node within depth, level by level; reached nodes leave the front."""
    both = undirected(edges).select("src", "dst").distinct()
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for k in range(1, depth + 1):
        front = front.join(both, front["node"] == both["src"]).select("seed", F.col("dst").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def reconciled(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    e, a = expected.groupBy(key).agg(F.count("*").alias("expected")), actual.groupBy(key).agg(F.count("*").alias("actual"))
    return e.join(a, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("delta", F.col("actual") - F.col("expected"))


def relation_faults(relations: DataFrame, nodes: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(src, type, dst, evidence) with the reasons against each, joined by "; ".  Whether a type fits its ends is only asked where nothing
    before was wrong."""
    n = nodes.select("id", "kind").distinct()
    r = relations.join(n.toDF("src", "src_kind"), "src", "left").join(n.toDF("dst", "dst_kind"), "dst", "left")
    known = sorted({k for pair in kinds.values() for k in pair})
    want = F.create_map(*[F.lit(x) for t, (a, b) in kinds.items() for x in (t, f"{a}>{b}")])
    rule = F.try_element_at(want, "type")
    missing = F.col("src").isNull() | F.col("dst").isNull()
    odd = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*known)
    no_end = F.col("src_kind").isNull() | F.col("dst_kind").isNull()
    fits = F.coalesce(F.concat_ws(">", "src_kind", "dst_kind") == rule, F.lit(False))
    faults = F.array_compact(F.array(
        F.when(missing, F.lit("missing id")),
        F.when(rule.isNull(), F.lit("unknown type")),
        F.when(odd("src_kind") | odd("dst_kind"), F.lit("unknown kind")),
        F.when(no_end, F.lit("unknown endpoint")),
        F.when(~missing & rule.isNotNull() & ~odd("src_kind") & ~odd("dst_kind") & ~no_end & ~fits, F.lit("type does not fit kinds")),
        F.when(F.col("src") == F.col("dst"), F.lit("self loop")),
        F.when(F.trim(F.coalesce("evidence", F.lit(""))) == "", F.lit("no evidence")),
    ))
    return r.select("src", "type", "dst", F.array_join(faults, "; ").alias("reasons"))


def chain(links: DataFrame, longest: int) -> DataFrame:
    """(id, next_id) to (head, id, hops): every node's distance from the head of its chain, by pointers alone.

    Pointers double: after k rounds each node knows the one 2^k before it, so chains of at most `longest` nodes take the logarithm of that
    in joins.  Of several pointers to one node the least id's counts; a node whose head is farther off, or that is on a ring, has no head."""
    before = links.where("next_id is not null").groupBy(F.col("next_id").alias("id")).agg(F.min("id").alias("up"))
    state = links.select("id").distinct().join(before, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    for _ in range(max(1, longest - 1).bit_length()):
        state = settled(state)
        far = state.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("hops").alias("more"))
        state = state.join(far, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
    heads = links.select(F.col("id").alias("up")).distinct().join(before.select(F.col("id").alias("up")), "up", "left_anti")
    return state.join(heads.withColumn("found", F.lit(True)), "up", "left").select(F.when(F.col("found"), F.col("up")).alias("head"), "id", F.when(F.col("found"), F.col("hops")).alias("hops"))


def seeded(seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """(node, score) seeds and (node, hops, score) of what was reached: each node once, a seed as such, else by the fewest hops."""
    rows = seeds.select("node", F.lit(True).alias("is_seed"), F.lit(0).alias("hops"), "score").unionByName(expanded.select("node", F.lit(False).alias("is_seed"), "hops", "score"))
    best = F.max(F.struct("is_seed", (-F.col("hops")).alias("minus"), "score")).alias("b")
    return rows.groupBy("node").agg(best).select("node", "b.is_seed", (-F.col("b.minus")).alias("hops"), "b.score")


def constraint_faults(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(label, key, nulls, repeated) of each table's unique key: what a uniqueness constraint would refuse."""
    out = None
    for label, (df, key) in tables.items():
        n = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
        row = n.agg(F.lit(label).alias("label"), F.lit(key).alias("key"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated"))
        out = row if out is None else out.unionByName(row)
    return out


def loaded(documents: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, title, code) roots and (doc_id, relation, code, title) references to nodes and edges.

    A reference to a root's code is an edge to that root; every other code is a placeholder node, made once, with the least title given
    for it.  Edges are kept once; a root that refers to itself has no edge."""
    roots = documents.select(F.col("doc_id").cast("string").alias("id"), "title", "code", F.lit(True).alias("is_root"))
    owner = roots.where("code is not null").groupBy("code").agg(F.min("id").alias("root"))
    aimed = references.select(F.col("doc_id").cast("string").alias("src"), "relation", "code", "title").join(owner, "code", "left")
    edges = aimed.select("src", F.col("relation").alias("type"), F.coalesce("root", "code").alias("dst")).where("src <> dst").distinct()
    placeholders = aimed.where("root is null").groupBy(F.col("code").alias("id")).agg(F.min("title").alias("title"))
    nodes = roots.unionByName(placeholders.select("id", "title", F.col("id").alias("code"), F.lit(False).alias("is_root")))
    return nodes, edges

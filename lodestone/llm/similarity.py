"""Similarity join on sets of 5-word shingles, by chosen paths.

Texts with equal shingle sets form one set.  In a run, each set samples about `roots` of its tokens by a hash that all sets share;
sets with a sampled token in common meet in its bucket.  Buckets of at most `split` sets are compared by brute force.  A larger
bucket is split where that pays: each set goes on to the buckets of further sampled tokens, of which sets that are similar enough
share one or more on average, and so on.  The roots of a bounded sample of a bucket's sets, which are sampled tokens themselves,
tell how many children two of its sets share on average (x).  A split leaves x of the pairs to compare; it pays if it saves each set more than `split` comparisons,
and if x is at most MEET, as else the further runs that splits take cost more than they save.  Other buckets are compared in
full, in blocks of bounded size: in those above MEET most sets are near copies, and a share of the pairs are links to count.
Each pair is compared on all its tokens, in the first bucket that it shares.

Runs are repeated, with fresh samples, until the recall is reached at the depth of splits that was met.  A pair at the threshold
shares each root of its sets with a chance of 0.8, and 0.8 * FANOUT = 1 children of a node on average, at the least.  The chance s that
a shared node still has a shared path d splits below follows s(0) = 1, s(d + 1) = 1 - exp(-s(d)).  So of a set's roots one that was not
split misses a partner with a chance of 0.2, and one that was, of 1 - 0.8 * s(d); a set runs again while the product over its
roots, of all runs, is above 1 - TARGET.

What leaves a bucket are counts and stars of links, never its pairs.  Buckets with the same members are compared once.
Connected components of the links (alternating large and small stars) are the classes.

Words are maximal runs of digits, letters and bytes from 128 on, with A-Z in lower case.  Rows: a text of fewer than five
words is one shingle; null and wordless texts have no links and are a class each (by id); a class's id is its least doc_id,
null only where all its ids are; rows repeated under one id count as different documents of one set; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch, cut, mix, removed, table, utf8
from .decontaminate import Words

SHINGLE = 5
ROOTS = 12
FANOUT = 1.25  # 1 / 0.8: similar sets share one of the next tokens on average, so that unlike ones part
TARGET = 0.999
DEPTH = 8
SPLIT = 2048
MEET = 0.8
BLOCK = 2048
VOLUME = 1 << 21  # tokens of a block
TILE = 1024  # rows and columns of the matrix of shared tokens that a task holds
SAMPLE = 48  # sets, on average, of which all pairs are compared to rate a bucket
COMPANY = 0.3  # share of its roots at which a set must meet others
NUM, DEN = 4, 5  # the threshold, 0.8
LEAST = 4  # a set of fewer shingles is similar enough to no other: 3 / 4 is below the threshold


def survival(depth: int) -> float:
    """Chance that a pair at the threshold that shares a node shares one `depth` splits below it."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-NUM / DEN * FANOUT * s)
    return s


def missed(depth: int) -> tuple[float, float]:
    """Logarithms of the chances to miss a partner at a root that was not split, and at one that was, down to a depth."""
    return math.log(1 - NUM / DEN), math.log(1 - NUM / DEN * survival(depth))


def lost_to_company(n: int, roots: float = ROOTS) -> float:
    """Chance that a set of n tokens that shares four fifths of them with another meets it, and yet too few others, at its roots."""
    shared, p = -(-n * NUM // DEN), min(1.0, roots / n)
    chance = lambda k, of: math.comb(of, k) * p**k * (1 - p) ** (of - k)
    return sum(chance(k, shared) * chance(j, n - shared) for j in range(n - shared + 1) for k in range(1, shared + 1) if k < math.floor((k + j) * COMPANY))


def sets_of(offsets: np.ndarray, data: np.ndarray, words: Words) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    _, _, h, first = words.of(offsets, data)
    h = mix(h)
    shingle = h.copy()
    for k in range(1, SHINGLE):
        shingle[:-k] = mix(shingle[:-k] * np.uint64(3) + h[k:], k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(shingle[a : b - SHINGLE + 1])
        elif b > a:
            one = h[a : a + 1]
            for k in range(1, b - a):
                one = mix(one * np.uint64(3) + h[a + k : a + k + 1], k + 100)
            yield one
        else:
            yield h[:0]


def sampled(tokens: np.ndarray, node: int, expected: float, n: int) -> np.ndarray:
    """Buckets below a node (0: the root) in which a set of n tokens stands."""
    r = mix(tokens ^ np.uint64(node % 2**64), 1)
    kept = tokens[r < np.uint64(min(2**64 - 1, int(expected / max(n, 1) * 2**64)))]
    return mix(kept + mix(np.array([node % 2**64], np.uint64), 2), 3).view(np.int64)


SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("sig", pa.binary()), ("n", pa.int32()), ("tokens", pa.list_(pa.int32())), ("roots", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch], roots: float) -> Iterator[pa.RecordBatch]:
    words = Words()
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            sig, n, tokens, paths = [], [], [], []
            for s in sets_of(*utf8(b.column(2)), words):
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                short = np.unique(s.astype(np.uint32))
                n.append(len(short))
                tokens.append(short.view(np.int32))
                paths.append(np.unique(sampled(short.astype(np.uint64), 0, roots, len(short))))
            yield batch(SETS, doc_id=b.column(0), key=b.column(1), sig=sig, n=n, tokens=tokens, roots=paths)


def shingle_sets(docs: DataFrame, roots: float = ROOTS) -> DataFrame:
    """doc_id, the text's md5, set digest (null: no words), tokens (32-bit hashes) and root buckets, written once."""
    made = docs.selectExpr("cast(doc_id as bigint) doc_id", "unhex(md5(coalesce(text, ''))) key", "text").mapInArrow(lambda bs: _sets(bs, roots), "doc_id long, key binary, sig binary, n int, tokens array<int>, roots array<long>")
    return cut(made, "sets")


def _children(frames: Iterator[pd.DataFrame], expected: float) -> Iterator[pd.DataFrame]:
    """The buckets below each of a set's paths."""
    for f in frames:
        rows: tuple[list, list, list] = ([], [], [])
        for sig, paths, held in zip(f["sig"], f["paths"], f["tokens"]):
            tokens = np.asarray(held, np.int32).view(np.uint32).astype(np.uint64)
            for p in paths:
                rows[0].append(p)
                rows[1].append(np.unique(sampled(tokens, int(p), expected, len(tokens))))
                rows[2].append(sig)
        yield pd.DataFrame({"parent": np.array(rows[0], np.int64), "kids": rows[1], "sig": rows[2]})


def children(held: DataFrame, tokens: DataFrame, expected: float) -> DataFrame:
    """(parent, sig, path) for (path, sig); a set's tokens are sent once for all its paths, of which it has few."""
    by_set = held.groupBy("sig").agg(F.collect_list("path").alias("paths")).join(tokens, "sig").select("sig", "paths", "tokens")
    made = by_set.mapInPandas(lambda fs: _children(fs, expected), "parent long, kids array<long>, sig binary")
    return made.select("parent", "sig", F.explode("kids").alias("path"))


def shared_tokens(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many tokens each set of a has in common with each of b; without b, with each other of a (the diagonal means nothing)."""
    other = a if b is None else b
    out = np.zeros((len(a), len(other)), np.float32)
    ra, ta = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.concatenate([*a, np.zeros(0, np.int32)])
    if b is None:
        both, n = np.unique(ta, return_counts=True)
        both, rb, tb = both[n > 1], ra, ta
    else:
        rb, tb = np.repeat(np.arange(len(b)), [len(x) for x in b]), np.concatenate([*b, np.zeros(0, np.int32)])
        both = np.intersect1d(ta, tb)
    ka, kb = np.isin(ta, both), np.isin(tb, both)
    ra, rb, ta, tb = ra[ka], rb[kb], np.searchsorted(both, ta[ka]), np.searchsorted(both, tb[kb])
    oa, ob = np.argsort(ta, kind="stable"), np.argsort(tb, kind="stable")
    ra, ta, rb, tb = ra[oa], ta[oa], rb[ob], tb[ob]
    for lo in range(0, len(both), 2048):
        x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(other), 2048), np.float32)
        s, e = np.searchsorted(ta, [lo, lo + 2048])
        x[ra[s:e], ta[s:e] - lo] = 1
        s, e = np.searchsorted(tb, [lo, lo + 2048])
        y[rb[s:e], tb[s:e] - lo] = 1
        out += x @ y.T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets of a are similar enough to which of b, or of a; none to itself."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in (a if b is None else b)])
    link = (NUM + DEN) * shared_tokens(a, b) >= NUM * (na[:, None] + nb[None, :])
    if b is None:
        np.fill_diagonal(link, False)
    return link


def _rate(f: pd.DataFrame) -> pd.DataFrame:
    """How many children two of a bucket's sampled sets share, on average, by their roots but for the one that brought them here."""
    roots, m = [np.asarray(x, np.int64) for x in f["roots"]], len(f)
    n = f["r"].to_numpy(np.float64)
    meet = FANOUT * np.maximum(shared_tokens(roots) - 1, 0) / np.maximum(np.maximum(n[:, None], n[None, :]) - 1, 1)
    np.fill_diagonal(meet, 0)
    return pd.DataFrame({"path": f["path"].iloc[:1], "meet": [float(meet.sum() / max(1, m * (m - 1)))]})


def rated(held: DataFrame, large: DataFrame, rooted: DataFrame, split: int) -> DataFrame:
    """(path, m, pays) of large buckets, from a bounded sample of each one's sets."""
    unit = (F.xxhash64("path", "sig").cast("double") + 2.0**63) / 2.0**64
    some = held.join(large, "path").where(unit * F.col("m") < SAMPLE).select("path", "sig").join(rooted, "sig")
    rates = some.select("path", "roots", "r").groupBy("path").applyInPandas(_rate, "path long, meet double")
    x = F.coalesce("meet", F.lit(0.0))
    return large.join(rates, "path", "left").select("path", "m", ((x <= MEET) & ((1 - x) * F.col("m") > split)).alias("pays"))


def leaves(first: DataFrame, tokens: DataFrame, split: int = SPLIT) -> tuple[DataFrame, int, DataFrame | None]:
    """One run from its roots, (path, sig, r: the set's number of roots): (path, sig) of the buckets to compare, the number of splits made
    below a root, and of each set with a split root r and how many were split (k)."""
    found, cleft, depth, paths = None, None, 0, first.select("path", "sig")
    rooted = first.groupBy("sig").agg(F.collect_list("path").alias("roots"), F.first("r").alias("r"))
    while True:
        sizes = cut(paths.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "buckets", light=True)
        small = paths.join(sizes.where(F.col("m") <= split).select("path"), "path", "left_semi")
        found = small if found is None else found.unionByName(small)
        large = sizes.where(F.col("m") > split)
        if large.isEmpty():
            return found, depth, cleft
        held = cut(paths.join(large.select("path"), "path", "left_semi"), "large", light=True)
        if depth == DEPTH:
            return found.unionByName(held), depth, cleft
        rating = cut(rated(held, large, rooted, split), "rated", light=True)
        found = found.unionByName(held.join(rating.where("not pays").select("path"), "path", "left_semi"))
        if rating.where("pays").isEmpty():
            return found, depth, cleft
        parted = held.join(rating.where("pays").select("path"), "path", "left_semi")
        if cleft is None:
            cleft = cut(parted.groupBy("sig").agg(F.count("*").alias("k")).join(rooted.select("sig", "r"), "sig"), "cleft", light=True)
        paths = cut(children(parted, tokens, FANOUT).select("path", "sig").distinct(), "children")
        depth += 1


def runs(met: DataFrame, tokens: DataFrame, split: int = SPLIT, roots: float = ROOTS, target: float = TARGET) -> DataFrame:
    """(path, sig) of the buckets to compare, of as many runs as the target takes; buckets with the same members once.
    met: the roots of the first run, as leaves() takes them."""
    with Workspace(met.sparkSession) as tables:
        found, depth, cleft = leaves(met, tokens, split)
        risks, run = None, 1
        while cleft is not None:
            # Sets without a split root have met their partners, or none.
            whole, parted = missed(depth)
            lost = (F.col("r") - F.col("k")) * whole + F.col("k") * parted
            now = cleft.select("sig", lost.alias("now")) if risks is None else cleft.join(risks, "sig").select("sig", (lost + F.col("lost")).alias("now"))
            risks = cut(now.where(F.col("now") > math.log(1 - target)).select("sig", F.col("now").alias("lost")), "risks", light=True)
            if risks.isEmpty():
                break
            # A run's number stands for its root.
            fresh = cut(children(risks.select("sig", F.lit(run).cast("long").alias("path")), tokens, roots).select("path", "sig").distinct(), f"run-{run}")
            more, depth, cleft = leaves(fresh.join(fresh.groupBy("sig").agg(F.count("*").alias("r")), "sig"), tokens, split)
            found, run = found.unionByName(more), run + 1
        found = tables.keep(cut(found, "found", light=True))
    members = found.groupBy("path").agg(F.count("*").alias("m"), F.sum(F.xxhash64("sig").cast("decimal(20,0)")).alias("members"))
    return found.join(members.groupBy("m", "members").agg(F.min("path").alias("path")).select("path"), "path", "left_semi")


PAIRS = pa.schema([("sig", pa.binary()), ("other", pa.binary()), ("n_texts", pa.int64()), ("n_links", pa.int64())])
FEW = 8  # sets of a bucket that are compared pair by pair


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _few(path: int, cross: int, tokens: list[np.ndarray], leaves_: list[np.ndarray]) -> np.ndarray:
    """Links of a small block, pair by pair; cross: where its second part begins, if only pairs between the two count."""
    m = len(tokens)
    link = np.zeros((m, m), bool)
    for i in range(cross or m):
        for j in range(max(i + 1, cross), m):
            n = len(tokens[i]) + len(tokens[j])
            # Pairs that share an earlier bucket are compared there.
            if (NUM + DEN) * min(len(tokens[i]), len(tokens[j])) >= NUM * n and not np.isin(leaves_[i][leaves_[i] < path], leaves_[j]).any():
                link[i, j] = link[j, i] = (NUM + DEN) * len(np.intersect1d(tokens[i], tokens[j], assume_unique=True)) >= NUM * n
    return link


def _least(link: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the least number that it reaches by links within a tile."""
    while True:
        na = np.minimum(a, np.where(link, b[None, :], most).min(axis=1))
        nb = np.minimum(b, np.where(link, na[:, None], most).min(axis=0))
        if (na == a).all() and (nb == b).all():
            return na, nb
        a, b = na, nb


def _block(path: int, cross: int, tokens: list[np.ndarray], leaves_: list[np.ndarray], copies: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """All pairs of a block, or between its two parts: set, the least set linked to it, and numbers of sets and documents linked, by tile."""
    m, out = len(tokens), []
    if m <= FEW:
        link = _few(path, cross, tokens, leaves_)
        k, at = np.flatnonzero(link.any(axis=1)), np.arange(m)
        return [(k, _least(link, at, at, m)[0][k], link.sum(axis=1)[k], (link @ copies)[k])] if len(k) else []
    earlier: dict[int, list[int]] = {}
    for i, ls in enumerate(leaves_):
        for p in ls[ls < path].tolist():
            earlier.setdefault(p, []).append(i)
    met = [np.array(x) for x in earlier.values() if len(x) > 1]
    tiles = lambda lo, hi: [np.arange(k, min(k + TILE, hi)) for k in range(lo, hi, TILE)]
    rows, columns = tiles(0, cross or m), tiles(cross, m)
    for p, a in enumerate(rows):
        for b in columns if cross else columns[p:]:
            same = a[0] == b[0]
            link = linked([tokens[i] for i in a], None if same else [tokens[i] for i in b])
            for members in met if link.any() else ():
                x, y = members[(members >= a[0]) & (members <= a[-1])], members[(members >= b[0]) & (members <= b[-1])]
                if len(x) and len(y):
                    link[np.ix_(x - a[0], y - b[0])] = False
            if not link.any():
                continue
            la, lb = _least(link, a, b, m)
            both = ((a, la, link.sum(axis=1), link @ copies[b]), (b, lb, link.sum(axis=0), copies[a] @ link))
            out += [tuple(x[texts > 0] for x in (at, label, texts, docs)) for at, label, texts, docs in both[: 1 if same else 2]]
    return out


def _blocks(t: pa.Table) -> pa.RecordBatch:
    """Whole blocks, in order of (path, i, j): star edges, and counts that add up."""
    path, i, j, blk, copies = (t.column(k).to_numpy() for k in range(5))
    sig = t.column(5).to_pylist()
    leaves_, tokens = (_lists(t.column(k).combine_chunks()) for k in (6, 7))
    edge = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    rows: tuple[list, ...] = ([], [], [], [])
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(path)]):
        order = lo + np.argsort(blk[lo:hi], kind="stable")
        cross = 0 if i[lo] == j[lo] else int((blk[lo:hi] == i[lo]).sum())
        if i[lo] != j[lo] and cross in (0, hi - lo):
            continue
        for at, label, texts, docs in _block(int(path[lo]), cross, [tokens[k] for k in order], [leaves_[k] for k in order], copies[order]):
            rows[0].extend(sig[k] for k in order[at])
            rows[1].extend(sig[k] for k in order[label])
            rows[2].extend(texts.tolist())
            rows[3].extend(docs.tolist())
    return batch(PAIRS, **dict(zip(PAIRS.names, rows)))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    key = lambda b, k: tuple(b.column(c)[k].as_py() for c in range(3))
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if key(held[0], 0) == key(b, len(b) - 1):
            continue  # still within one block, which its size bounds
        t = pa.Table.from_batches(held)
        last = key(b, len(b) - 1)
        same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in enumerate(last)])
        first = len(same) - int(same[::-1].argmin())
        yield _blocks(t.slice(0, first))
        held = t.slice(first).to_batches()
    if held:
        yield _blocks(pa.Table.from_batches(held))


def links(sets: DataFrame, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(sig, other, n_texts, n_links), of which a sig has several rows: star edges, and counts that add up."""
    with Workspace(sets.sparkSession) as tables:
        return tables.keep(cut(_links(sets, split, block), "links"))


def _links(sets: DataFrame, split: int, block: int) -> DataFrame:
    named = sets.where("sig is not null")
    counts = named.groupBy("sig").agg(F.count("*").alias("copies"))
    met = cut(named.where(F.col("n") >= LEAST).select("sig", F.size("roots").alias("r"), F.explode("roots").alias("path")).distinct(), "paths")
    # A set finds four fifths of its sampled tokens, on average, in any set that is similar enough.  Sets that meet others at fewer
    # than COMPANY of theirs leave before tokens are fetched, twice, as sets leave; see lost_to_company().
    for _ in range(2):
        held = met.join(met.groupBy("path").agg(F.count("*").alias("m")).where("m > 1").select("path"), "path", "left_semi")
        enough = held.groupBy("sig").agg(F.first("r").alias("r"), F.count("*").alias("k")).where(F.col("k") >= F.greatest(F.lit(1), F.floor(F.col("r") * COMPANY)))
        met = cut(held.join(enough.select("sig"), "sig", "left_semi"), "met", light=True)
    met = met.select("path", "sig", "r")
    # One row of each set that meets another, with its tokens.
    wanted = met.select("sig").distinct()
    tokens = cut(named.join(wanted, "sig", "left_semi").select("sig", "n", "tokens").dropDuplicates(["sig"]).join(counts, "sig"), "tokens")
    leaf = cut(runs(met, tokens.select("sig", "tokens"), split), "leaves")
    volume = leaf.join(tokens.select("sig", "n"), "sig").groupBy("path").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    # Blocks grow with a bucket, so that a set isn't sent once for every 2048 others.
    g = F.greatest(F.least(F.ceil(F.col("m") / block), F.lit(32)), F.ceil(F.col("m") / (8 * block)), F.ceil(F.col("t") / VOLUME))
    sizes = volume.select("path", g.cast("int").alias("g"))
    own = leaf.groupBy("sig").agg(F.collect_set("path").alias("leaves"))
    rows = leaf.join(sizes, "path").withColumn("blk", F.pmod(F.xxhash64("sig"), F.col("g")).cast("int")).join(own, "sig").join(tokens, "sig")
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, F.col("blk")).alias("i"), F.greatest(k, F.col("blk")).alias("j")))
    dealt = rows.withColumn("pair", F.explode(pairs)).select("path", "pair.i", "pair.j", "blk", "copies", "sig", "leaves", "tokens")
    dealt = dealt.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return dealt.mapInArrow(_compared, "sig binary, other binary, n_texts long, n_links long")


def components(edges: DataFrame) -> DataFrame:
    """(sig, root) of a graph given as (sig, other), by alternating large and small stars until nothing moves."""
    edges = edges.where("sig <> other").select(F.greatest("sig", "other").alias("u"), F.least("sig", "other").alias("v")).distinct()
    before, last = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = cut(small, "stars", light=True)
        if last:
            removed(edges.sparkSession, last)
        last = edges.written_at
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("sig"), F.col("v").alias("root"))
        before = state


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, key, sig, root (the class, null without words), class_id, n_links (other documents linked, copies included) and n_texts (different sets linked)."""
    sets = shingle_sets(docs)
    found = links(sets, **how)
    ids = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    counts = found.groupBy("sig").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_links").alias("n_links"))
    roots = components(found.select("sig", "other"))
    rooted = ids.join(roots, "sig", "left").join(counts, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = cut(rooted, "rooted", light=True)
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    known = rooted.join(least, "root").select("sig", "root", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    return sets.select("doc_id", "key", "sig").join(known, "sig", "left").select("doc_id", "key", "sig", "root", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One row of each class, with all columns: that of the least doc_id (a null id after all others), of its texts the one with the
    least md5, of rows repeated with id and text any one.  Wordless documents are in no class and all stay."""
    found = classes(docs, **how).where("sig is not null").withColumn("who", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    found = cut(found.select("doc_id", "key", "root", "who"), "found", light=True)
    best = found.groupBy("root").agg(F.min("who").alias("best"))
    gone = found.join(best, "root").where("who <> best").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    same = found.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    key, doc_id = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))), docs["doc_id"].cast("long")
    on = lambda other: doc_id.eqNullSafe(other["gone_id"]) & (key == other["gone_key"])
    kept = docs.join(gone, on(gone), "left_anti")
    # Rows repeated with id and text, few or none, are the only ones of which one is chosen.
    if same.isEmpty():
        return kept
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, number = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    once = kept.join(same, on(same), "left_semi").toDF(*names).dropDuplicates([number, text]).toDF(*docs.columns)
    return kept.join(same, on(same), "left_anti").union(once)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("key", "sig", "root")

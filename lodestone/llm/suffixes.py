"""Suffix-array deduplication of bytes: every byte covered by a 100-byte string that also starts earlier is removed.

Suffixes are put in order through their first 100 bytes only, by most-significant-digit passes; equal groups are then exactly
the repeated windows.  The first digit deals the windows out: the window's anchor, the least-hashed 16-byte string in it, which
its content alone decides.  Windows in a row with one anchor are a run and travel as one row.

1. Runs, as (anchor hash, hash of the run's bytes, place), are dealt by anchor; equal runs are whole repeats.  Tasks keep but
   the first of equal runs before dealing, so common text is folded early.
2. The first of each sort of run whose anchor has several sorts may still share windows with the others.  Their bytes are
   fetched, and all their windows are sorted by digits of eight bytes, groups of one leaving after each pass.
3. An anchor with more than MANY sorts of runs, as a line has that stands in very many texts, is no task of its own: its windows
   are dealt out by all their digits at once, as two hashes, and the first of equal ones is found by a partial aggregation.
4. The repeated windows of each document are joined to its text.

Order is by (doc_id, start), a null id before all others; rows under one id count as one document, and rows repeated with their
text each get the same result.  Null and empty texts have no bytes.  Texts under 100 bytes keep all.  Very long texts are hashed in
segments that overlap by a window less one, and keep their runs.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, mix, table, utf8
from .decontaminate import _powers, _ranges

WIDTH = 100
GRAM = 16
SPAN = WIDTH - GRAM + 1  # anchors that a window can have
SEGMENT = 1 << 20
HELD = 1 << 21  # runs folded at once
MANY = 2048  # sorts of runs that one task sorts the windows of
FEW = 1 << 16  # anchors with more that are sent to the tasks; beyond, they are joined
LEAST = -(2**63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    def __init__(self, seed: int = 23):
        self.up, self.down, self.random = _powers(seed)

    def of(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchor hash, content hash, text, start and windows of each run; edges: where the texts in data begin and end."""
        none = (np.zeros(0, np.int64),) * 5
        if len(data) < WIDTH:
            return none
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.random[data] * self.up[: len(data)], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * self.down[: len(data) - GRAM + 1])
        low = np.uint64((1 << 20) - 1)
        anchor = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPAN) & low).astype(np.int64)
        starts = np.arange(len(anchor))
        text = np.searchsorted(edges, starts, side="right") - 1
        whole = starts + WIDTH <= edges[text + 1]
        starts, anchor, text = starts[whole], anchor[whole], text[whole]
        if not len(starts):
            return none
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(starts)))
        s = starts[first]
        content = mix(mix((sums[s + n + WIDTH - 1] - sums[s]) * self.down[s], 5) + n.astype(np.uint64), 6)
        return grams[anchor[first]].view(np.int64), content.view(np.int64), text[first], s - edges[text[first]], n


    def windows(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of each window that begins at one of the places; data is at most a segment."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.random[data] * self.up[: len(data)], out=sums[1:])
        return mix(mix((sums[at + WIDTH] - sums[at]) * self.down[at], 7), 8).view(np.int64)


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First text, text after the last, first and last byte: whole texts, or parts of a long one that overlap by a window less one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, side="right")) - 1)
        if j > i + 1 or offsets[j] - offsets[i] <= SEGMENT:
            yield i, j, int(offsets[i]), int(offsets[j])
        else:
            for at in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - WIDTH + 1), SEGMENT - WIDTH + 1):
                yield i, j, at, min(at + SEGMENT, int(offsets[j]))
        i = j


RUNS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("t", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])


def _folded(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The first of equal runs, to be compared; the others are repeats, joined where they follow each other (c is null)."""
    h, c, doc, t, start, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc, c, h))
    h, c, doc, t, start, n = h[order], c[order], doc[order], t[order], start[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (doc != doc[head]) | (start != start[head])
    k = np.flatnonzero(new | ~later)
    yield batch(RUNS, h=h[k], c=c[k], doc=doc[k], t=t[k], start=start[k], n=n[k])
    doc, t, start, n = _joined(*(x[later] for x in (doc, t, start, n)))
    yield batch(RUNS, h=mix(doc.view(np.uint64), 9).view(np.int64), c=pa.nulls(len(doc), pa.int64()), doc=doc, t=t, start=start, n=n)


def _joined(doc: np.ndarray, t: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that touch or overlap as one."""
    order = np.lexsort((start, t, doc))
    doc, t, start, n = doc[order], t[order], start[order].astype(np.int64), n[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    # Runs of one text overlap only where it is repeated under one id, so the end before is the greatest so far.
    new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (start[1:] > (start + n)[:-1])
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(start + n, first) if len(first) else start
    return doc[first], t[first], start[first], end - start[first]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, held, size = Runs(), [], 0
    for b in batches:
        offsets, data = utf8(b.column(2))
        doc, t = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, j, lo, hi in _segments(offsets):
            edges = np.concatenate([[lo], np.minimum(offsets[i + 1 : j + 1], hi)]) - lo if j > i + 1 else np.array([0, hi - lo])
            h, c, text, start, n = made.of(data[lo:hi], edges)
            if len(h):
                held.append((h, c, doc[i + text], t[i + text], (start + lo - offsets[i] if j == i + 1 else start).astype(np.int32), n.astype(np.int32)))
                size += len(h)
        if size > HELD:
            yield from _folded(held)
            held, size = [], 0
    if held:
        yield from _folded(held)


FOUND = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("t", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (h, c, doc, start): repeats (h null), and the first runs of anchors with several sorts (h)."""
    held: list[np.ndarray] | None = None  # the last row's anchor, sort and the first place of that sort
    single: tuple | None = None  # the only first run so far of the last anchor
    for b in batches:
        if not len(b):
            continue
        done = np.asarray(b.column(1).is_null())
        h, doc, t, start, n = (b.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        c = b.column(1).fill_null(0).to_numpy()
        if done.any():
            k = np.flatnonzero(done)
            yield batch(FOUND, h=pa.nulls(len(k), pa.int64()), doc=doc[k], t=t[k], start=start[k], n=n[k])
            h, c, doc, t, start, n = (x[~done] for x in (h, c, doc, t, start, n))
            if not len(h):
                continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        carried = held is not None and h[0] == held[0] and c[0] == held[1]
        new[0] = not carried
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        from_before = head < 0
        d0, s0 = np.where(from_before, held[2] if carried else 0, doc[head]), np.where(from_before, held[3] if carried else 0, start[head])
        k = np.flatnonzero((doc != d0) | (start != s0))
        if len(k):
            yield batch(FOUND, h=pa.nulls(len(k), pa.int64()), doc=doc[k], t=t[k], start=start[k], n=n[k])
        same_before = held is not None and h[0] == held[0]
        f = np.flatnonzero(new)
        hf = h[f]
        counts = np.zeros(len(f), np.int64)
        if len(f):
            edge = np.flatnonzero(np.append(True, hf[1:] != hf[:-1]))
            counts = np.repeat(np.diff(np.append(edge, len(hf))), np.diff(np.append(edge, len(hf))))
            if same_before:
                counts[hf == held[0]] += 1
        rows = []
        if single is not None and same_before and len(f) and hf[0] == single[0]:
            rows.append(single)
        k = f[counts > 1]
        if rows or len(k):
            cols = [np.concatenate([[r[q] for r in rows], x[k]]) if rows else x[k] for q, x in enumerate((h, doc, t, start, n))]
            yield batch(FOUND, **{name: np.asarray(x, dtype) for name, x, dtype in zip(FOUND.names, cols, (np.int64, np.int64, np.int32, np.int32, np.int32))})
        if len(f):
            i = f[-1]
            single = (h[i], doc[i], t[i], start[i], n[i]) if counts[-1] == 1 else None
        held = [h[-1], c[-1], d0[-1], s0[-1]]


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, t, text, runs to one row a run with its bytes."""
    out = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("t", pa.int32()), ("start", pa.int32()), ("bytes", pa.binary())])
    for whole in batches:
        for at in range(0, len(whole), 512):
            b = whole.slice(at, 512)
            offsets, data = utf8(b.column(2))
            rows = []
            for i, (doc, t, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                base = offsets[i]
                rows += [(r["h"], doc, t, r["start"], data[base + r["start"] : base + r["start"] + r["n"] + WIDTH - 1].tobytes()) for r in runs if not r["hot"]]
            yield batch(out, **dict(zip(out.names, zip(*rows) if rows else [[]] * 5)))


DEALT = pa.schema([("k", pa.int64()), ("l", pa.int64()), ("doc", pa.int64()), ("t", pa.int32()), ("start", pa.int32())])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, t, text, runs to one row a window of the runs of anchors with very many, with two hashes of its bytes."""
    made = Runs(23), Runs(29)
    for whole in batches:
        for at in range(0, len(whole), 512):
            b = whole.slice(at, 512)
            offsets, data = utf8(b.column(2))
            for i, (doc, t, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                hot = [r for r in runs if r["hot"]]
                for k in range(0, len(hot), SEGMENT // (SPAN + WIDTH)):
                    some = hot[k : k + SEGMENT // (SPAN + WIDTH)]
                    n, start = np.array([r["n"] for r in some]), np.array([r["start"] for r in some])
                    part = np.concatenate([data[offsets[i] + r["start"] : offsets[i] + r["start"] + r["n"] + WIDTH - 1] for r in some])
                    places = _ranges(np.cumsum(n + WIDTH - 1) - n - WIDTH + 1, n)
                    first, second = (m.windows(part, places) for m in made)
                    yield batch(DEALT, k=first, l=second, doc=[doc] * len(places), t=[t] * len(places), start=_ranges(start, n).astype(np.int32))


def repeated_windows(group: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of data (padded by 8 bytes), by start, that are equal to another of their group: their numbers in order of content, and
    the number of each one's equals.  Most-significant digits of eight bytes; groups of one leave after each pass."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    live = np.arange(len(at))
    label = np.unique(group, return_inverse=True)[1]
    for digit in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
        key = np.ascontiguousarray(view[at[live] + digit]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, label))
        live, label, key = live[order], label[order], key[order]
        new = np.ones(len(live), bool)
        new[1:] = (label[1:] != label[:-1]) | (key[1:] != key[:-1])
        label = np.cumsum(new) - 1
        keep = np.bincount(label, minlength=1)[label] > 1 if len(label) else new
        live, label = live[keep], label[keep]
        if not len(live):
            break
    return live, label


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of h: the windows that aren't the first of their equals, as repeats."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        # While all rows held are of one anchor there is nothing to sort yet.
        if size >= 16_384 and held[0].column(0)[0] != b.column(0)[len(b) - 1]:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t.column(0).to_numpy()
            k = int(np.searchsorted(h, h[-1], side="left"))  # the last anchor may go on
            if k:
                yield from _sorted(t.slice(0, k))
                held = t.slice(k).to_batches()
                size = len(t) - k
    if size:
        yield from _sorted(pa.Table.from_batches(held).combine_chunks())


def _sorted(t: pa.Table) -> Iterator[pa.RecordBatch]:
    h, doc, text, start = (t.column(k).to_numpy() for k in range(4))
    offsets, data = utf8(t.column(4).combine_chunks() if isinstance(t.column(4), pa.ChunkedArray) else t.column(4))
    n = np.diff(offsets) - WIDTH + 1
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    live, label = repeated_windows(h[run], offsets[run] + within, np.append(data, np.zeros(8, np.uint8)))
    if not len(live):
        return
    d, s = doc[run[live]], start[run[live]] + within[live]
    order = np.lexsort((s, d, label))
    live, label, d, s = live[order], label[order], d[order], s[order]
    head = np.maximum.accumulate(np.where(np.append(True, label[1:] != label[:-1]), np.arange(len(label)), 0))
    k = np.flatnonzero((d != d[head]) | (s != s[head]))
    doc, text, start, n = _joined(d[k], text[run[live[k]]], s[k], np.ones(len(k), np.int64))
    yield batch(FOUND, h=pa.nulls(len(doc), pa.int64()), doc=doc, t=text, start=start, n=n)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spans(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that runs of windows cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["start"] + r["n"] + WIDTH - 1) for r in runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            offsets, data = utf8(b.column(1))
            rows = []
            for i, (doc, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                text, sha, last, gone = data[offsets[i] : offsets[i + 1]].tobytes(), hashlib.sha256(), 0, spans(runs or [])
                for s, e in gone:
                    sha.update(text[last:s])
                    last = e
                sha.update(text[last:])
                rows.append((doc, len(text), sum(e - s for s, e in gone), len(gone), sha.hexdigest()))
            yield batch(OUT, **dict(zip(OUT.names, zip(*rows) if rows else [[]] * 5)))


def _flagged(runs: DataFrame, many: int) -> tuple[DataFrame, bool]:
    """The runs that are to be compared, with whether their anchor has more than `many`, and whether there is such an anchor."""
    hot = cut(runs.groupBy("h").agg(F.count("*").alias("n_runs")).where(F.col("n_runs") > many).select("h"), "anchors", light=True)
    n = hot.count()
    if not n:
        return runs.withColumn("hot", F.lit(False)), False
    marked = hot.withColumn("hot", F.lit(True))
    return runs.join(F.broadcast(marked) if n <= FEW else marked, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), True


def repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """(doc, t, start, n): runs of repeated windows; docs has doc, t and text."""
    runs = docs.where(F.octet_length("text") >= WIDTH).select("doc", "t", "text").mapInArrow(_runs, "h long, c long, doc long, t int, start int, n int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, "h").sortWithinPartitions("h", "c", "doc", "start")
    found = cut(dealt.mapInArrow(_resolved, "h long, doc long, t int, start int, n int"), "runs")
    marked, any_hot = _flagged(found.where("h is not null"), many)
    open_runs = marked.groupBy("doc", "t").agg(F.collect_list(F.struct("h", "start", "n", "hot")).alias("runs"))
    held = docs.join(open_runs, ["doc", "t"]).select("doc", "t", "text", "runs")
    fetched = held.mapInArrow(_fetched, "h long, doc long, t int, start int, bytes binary")
    compared = fetched.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_windows, "h long, doc long, t int, start int, n int")
    out = found.where("h is null").unionByName(cut(compared, "windows")).drop("h")
    if not any_hot:
        return out
    windows = cut(held.mapInArrow(_dealt, "k long, l long, doc long, t int, start int"), "dealt")
    first = windows.groupBy("k", "l").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("m")).where("m > 1").select("k", "l", "first")
    later = windows.join(first, ["k", "l"]).where(F.struct("doc", "start") != F.col("first"))
    return out.unionByName(later.select("doc", "t", "start", F.lit(1).alias("n")))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row a document: bytes, bytes and stretches removed, and the digest of what is kept."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.hash("text").alias("t"), "text")
    gone = repeats(keyed, **how).groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return keyed.join(gone, ["doc", "t"], "left").select("doc_id", "text", "runs").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))

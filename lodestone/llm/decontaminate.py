"""Benchmark decontamination with suffix arrays of the training text.

The training text is cut into shards (batches of whole documents).  Each shard's suffixes, by word, are sorted into a suffix
array, in which every test suffix (by its window of 10 words, or a whole shorter item) is found by binary search; its range in the
array is all its occurrences.  An occurrence is extended as far as document and item agree: windows that follow each other in both
are one match, so each match is the longest at its place, of one item, with its place in the item and in the document.
Two exact cuts keep the array small: a suffix enters only if its first window could be a test window, as all its words are test
words, and only windows whose first word occurs are searched.

Test items are sent to the tasks in blocks of at most block_bytes of text, so what is broadcast at once has a fixed bound: about
four times block_bytes, made on the driver in about twelve times block_bytes.  Words are compared by 64-bit hash and, at each hit,
by their bytes.

Rows: null or wordless texts have no words, no hits and aren't contaminated; null or wordless items have no windows; of items
with a null id the words count as hits, but they aren't named; repeated items with one id count once; very long texts are a
shard each, and their words are hashed in parts; repeated documents each have a row; null doc_ids stay null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, cut, table, utf8

WINDOW = 10
SHARD = 6 << 20
SEGMENT = 1 << 20

# Word bytes after lower-casing A-Z: digits, letters and all of 128 and above.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd base's powers and their inverses modulo 2**64, and a random number for each byte."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62)) | 1
    up, down = np.full(SEGMENT, base, np.uint64), np.full(SEGMENT, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), rng.integers(1, 1 << 63, 256, np.uint64)


class Words:
    """Places and hashes of the words in concatenated texts."""

    def __init__(self, seed: int = 11):
        self.up, self.down, self.random = _powers(seed)
        self.random[~IS_WORD] = 0

    def of(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word, and the number of words before each text (n + 1)."""
        low = LOWER[data]
        word = IS_WORD[low]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        h = np.zeros(len(s), np.uint64)
        at = 0
        while at < len(s):  # as many whole words as a segment holds; a longer word is hashed in parts
            stop = int(np.searchsorted(e, s[at] + SEGMENT, side="right"))
            if stop <= at:
                h[at] = self._long(low[s[at] : e[at]])
                at += 1
                continue
            base = s[at]
            part = self.random[low[base : e[stop - 1]]] * self.up[: e[stop - 1] - base]
            h[at:stop] = np.add.reduceat(part, s[at:stop] - base) * self.down[s[at:stop] - base]
            at = stop
        return s, e, h, np.searchsorted(s, offsets)

    def _long(self, low: np.ndarray) -> np.uint64:
        return np.uint64(sum(int((self.random[low[i : i + SEGMENT]] * self.up[: len(low[i : i + SEGMENT])]).sum(dtype=np.uint64)) * pow(int(self.up[1]), i, 1 << 64) for i in range(0, len(low), SEGMENT)) & (1 << 64) - 1)


@dataclass
class Tests:
    """A block of items as arrays: vocabulary (sorted hashes, bytes), the items' word numbers, and their distinct windows."""

    seed: int
    hashes: np.ndarray
    word_at: np.ndarray  # by word number: its bytes are word_bytes[word_at[k] : word_at[k + 1]]
    word_bytes: np.ndarray
    numbers: np.ndarray  # of all items' words, with -1 between the items and WINDOW times at the end
    windows: np.ndarray  # by distinct window: where it first stands in numbers
    lengths: np.ndarray
    places: np.ndarray  # all places of each window, in order
    first: np.ndarray  # by distinct window: its first entry in places (n + 1)
    starts: np.ndarray  # by item: its first place in numbers
    names: list[str | None]  # by item
    shortest: np.ndarray  # by word: the least length of a window that begins with it, or 127

    def word(self, k: int) -> bytes:
        return self.word_bytes[self.word_at[k] : self.word_at[k + 1]].tobytes()

    def items(self, windows: np.ndarray) -> set[str]:
        """Names of the items in which any of the windows stands."""
        at = _ranges(self.first[windows], self.first[windows + 1] - self.first[windows])
        found = np.unique(np.searchsorted(self.starts, self.places[at], side="right") - 1)
        return {self.names[i] for i in found.tolist() if self.names[i] is not None}

    @staticmethod
    def of(rows: list[tuple[str | None, str]]) -> Tests:
        raw = [x.encode() for _, x in rows]
        offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
        names = [name for name, _ in rows]
        del raw, rows
        for seed in range(11, 30):
            s, e, h, first = Words(seed).of(offsets, data)
            low = LOWER[data]
            hashes, example, number = np.unique(h, return_index=True, return_inverse=True)
            number = number.astype(np.int32)
            if _same_bytes(low, s, e, example[number]):
                break
        n = len(first) - 1
        length = np.diff(first)
        # Word k of item i stands at k + i, as one -1 follows each item.
        numbers = np.full(len(number) + n + WINDOW, -1, np.int32)
        numbers[np.arange(len(number)) + np.repeat(np.arange(n), length)] = number
        starts = first[:-1] + np.arange(n)
        many = np.maximum(length - WINDOW + 1, np.minimum(length, 1))
        at = _ranges(starts, many).astype(np.int32)
        size = np.repeat(np.minimum(length, WINDOW), many).astype(np.int8)
        for power in range(3, 99, 2):
            order, new = _grouped(numbers, at, size, np.uint64(0x9E3779B97F4A7C15 * power % 2**64))
            if order is not None:
                break
        at, size, head = at[order], size[order], np.flatnonzero(new)
        shortest = np.full(len(hashes) + 1, 127, np.int64)
        np.minimum.at(shortest, numbers[at[head]], size[head])
        spell = e[example] - s[example]
        return Tests(
            seed, hashes, np.append(0, np.cumsum(spell)), low[_ranges(s[example], spell)], numbers,
            at[head], size[head].astype(np.int64), at, np.append(head, len(at)), starts, names, shortest,
        )


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (many[0] of them), start[1], ..."""
    start, many = np.asarray(start, np.int64), np.asarray(many, np.int64)
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def _same_bytes(low: np.ndarray, s: np.ndarray, e: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word is spelled as the word that its number was taken from."""
    if (e - s != e[like] - s[like]).any():
        return False
    for at in range(0, len(s), 1 << 18):
        a, b, n = s[at : at + (1 << 18)], s[like[at : at + (1 << 18)]], (e - s)[at : at + (1 << 18)]
        if (low[_ranges(a, n)] != low[_ranges(b, n)]).any():
            return False
    return True


def _grouped(numbers: np.ndarray, at: np.ndarray, size: np.ndarray, power: np.uint64) -> tuple[np.ndarray | None, np.ndarray]:
    """Order of the windows by a hash of their words, then place, and where a new window begins; None if two differ under one hash."""
    h = size.astype(np.uint64)
    for d in range(WINDOW):
        h = (h ^ (h >> np.uint64(29))) * power + np.where(size > d, numbers[at + d].astype(np.int64) + 2, 1).astype(np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    a, b = order[:-1][~new[1:]], order[1:][~new[1:]]
    if (size[a] != size[b]).any():
        return None, new
    for d in range(WINDOW):
        if ((numbers[at[a] + d] != numbers[at[b] + d]) & (size[a] > d)).any():
            return None, new
    return order, new


def suffix_array(numbers: np.ndarray, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in the order of their suffixes' first WINDOW words, and those words (WINDOW x places)."""
    keys = np.full((WINDOW, len(at)), -1, np.int32)
    for d in range(WINDOW):
        inside = run[at] > d
        keys[d, inside] = numbers[at[inside] + d]
    order = np.lexsort(keys[::-1])
    return at[order], keys[:, order]


def search(keys: np.ndarray, tests: Tests, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the windows, many at once: the range of suffixes that begin with each."""
    low, high = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for at in range(0, len(windows), 1 << 16):
        some = windows[at : at + (1 << 16)]
        cared = np.arange(WINDOW)[:, None] < tests.lengths[some][None, :]
        q = tests.numbers[tests.windows[some][None, :] + np.arange(WINDOW)[:, None]]
        for out, after in ((low, False), (high, True)):
            lo, hi = np.zeros(len(some), np.int64), np.full(len(some), keys.shape[1], np.int64)
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                m, t = keys[:, mid], q[:, live]
                differ = (m != t) & cared[:, live]
                d, k = differ.argmax(axis=0), np.arange(len(live))
                below = np.where(differ.any(axis=0), m[d, k] < t[d, k], after)
                lo[live], hi[live] = np.where(below, mid + 1, lo[live]), np.where(below, hi[live], mid)
            out[at : at + len(some)] = lo
    return low, high


def _scan(offsets: np.ndarray, data: np.ndarray, tests: Tests, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' first word numbers; and for each occurrence its window, its place (word), length and text."""
    s, e, h, first = words.of(offsets, data)
    at = np.minimum(np.searchsorted(tests.hashes, h), len(tests.hashes) - 1)
    number = np.where(tests.hashes[at] == h, at, -1).astype(np.int32)
    while True:
        stops = np.union1d(np.flatnonzero(number < 0), first[1:])
        places = np.arange(len(number))
        run = stops[np.searchsorted(stops, places + (number >= 0), side="left")] - places if len(number) else places
        run = np.where(number >= 0, run, 0)
        enters = np.flatnonzero(run >= tests.shortest[number])  # number -1 meets the last entry, 127, which a run of 0 is under
        array, keys = suffix_array(number, run, enters)
        begins = np.zeros(len(tests.hashes), bool)
        begins[number[enters]] = True
        asked = np.flatnonzero(begins[tests.numbers[tests.windows]])
        lo, hi = search(keys, tests, asked)
        window, place = np.repeat(asked, hi - lo), array[_ranges(lo, hi - lo)]
        length = tests.lengths[window]
        # The words of all occurrences, compared by their bytes.
        hit = np.flatnonzero(_covered(place, length, len(number)))
        wrong = [i for i in hit.tolist() if LOWER[data[s[i] : e[i]]].tobytes() != tests.word(number[i])]
        if not wrong:
            return first, window, place, length, np.searchsorted(first, place, side="right") - 1
        number[wrong] = -1


def _covered(place: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + length, -1)
    return np.cumsum(change[:-1]) > 0


PAIRS = 1 << 21


def longest_matches(place: np.ndarray, window: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's occurrences, in order of place: place in the items, place in the text and length of each longest match.
    Occurrences meet all places of their window, PAIRS at once; on a diagonal, neighbours are one match."""
    many = tests.first[window + 1] - tests.first[window]
    edges = [0, *np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum(), PAIRS), side="left"), len(place)]
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        n, w = many[lo:hi], window[lo:hi]
        at = tests.places[_ranges(tests.first[w], n)].astype(np.int64)
        parts.append(_runs(at, np.repeat(place[lo:hi], n), np.repeat(tests.lengths[w], n)))
    return _runs(*(np.concatenate(x) for x in zip(*parts)))


def _runs(at: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of which one begins in the text and in the items where another's last window ends less one word, as one."""
    order = np.lexsort((place, place - at))
    at, place, length = at[order], place[order], length[order]
    diagonal, follows = place - at, np.zeros(len(at), bool)
    follows[1:] = (diagonal[1:] == diagonal[:-1]) & (place[1:] == place[:-1] + length[:-1] - WINDOW + 1) & (length[:-1] >= WINDOW) & (length[1:] >= WINDOW)
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(at)) - 1
    return at[first], place[first], place[last] + length[last] - place[first]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
MATCH = pa.struct([("item", pa.string()), ("at", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
STATE = [("__n_words", pa.int64()), ("__hits", pa.list_(SPAN)), ("__items", pa.list_(pa.string())), ("__matches", pa.list_(MATCH))]
STATE_SQL = [
    "0L __n_words",
    "cast(array() as array<struct<start: bigint, end: bigint>>) __hits",
    "cast(array() as array<string>) __items",
    "cast(array() as array<struct<item: string, at: bigint, start: bigint, length: bigint>>) __matches",
]


def _with_state(b: pa.RecordBatch, *state) -> pa.RecordBatch:
    new = [pa.array(x, t) for x, (_, t) in zip(state, STATE)]
    return pa.RecordBatch.from_arrays([*b.columns[: -len(STATE)], *new], names=b.schema.names)


def _pass(batches: Iterator[pa.RecordBatch], tests: Tests, column: int) -> Iterator[pa.RecordBatch]:
    """Adds a block's verbatim matches, as word spans, and items to each row."""
    words = Words(tests.seed)
    for whole in batches:
        at = 0
        while at < len(whole):  # shards of whole documents
            offsets, _ = utf8(whole.column(column).slice(at))
            n = max(1, int(np.searchsorted(offsets, SHARD, side="right")) - 1)
            b = whole.slice(at, n)
            at += n
            offsets, data = utf8(b.column(column))
            first, window, place, length, text = _scan(offsets, data, tests, words)
            hits, items, found = (b.column(k).to_pylist() for k in (-3, -2, -1))
            order = np.lexsort((place, text))
            window, place, length, text = window[order], place[order], length[order], text[order]
            edges = np.searchsorted(text, np.unique(text), side="left")
            for lo, hi in zip(edges, [*edges[1:], len(text)]):
                i = int(text[lo])
                own = place[lo:hi] - first[i]
                spans = joined([(x["start"], x["end"]) for x in hits[i]] + list(zip(own.tolist(), (own + length[lo:hi]).tolist())))
                hits[i] = [{"start": a, "end": z} for a, z in spans]
                items[i] = sorted({*items[i], *tests.items(np.unique(window[lo:hi]))})
                where, start, size = longest_matches(own, window[lo:hi], tests)
                item = np.searchsorted(tests.starts, where, side="right") - 1
                rows = zip(item.tolist(), (where - tests.starts[item]).tolist(), start.tolist(), size.tolist())
                found[i] += [{"item": tests.names[k], "at": a, "start": p, "length": z} for k, a, p, z in rows]
            yield _with_state(b, np.diff(first), hits, items, found)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most about block_bytes of text; the driver holds one block at a time."""
    rows = benchmark.selectExpr("cast(item_id as string) item_id", "text").where("text is not null and text <> ''").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // block_bytes)
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with __n_words, __hits (spans of words that windows cover, end exclusive), __items and __matches (the longest verbatim
    matches: item, place in it, place in the document, words).  With several blocks, the rows are written after each but the last, so
    that tasks hold one block at a time."""
    spark, column = docs.sparkSession, docs.columns.index("text")
    out, sent = docs.selectExpr("*", *STATE_SQL), None
    with Workspace(spark) as tables:
        for rows in blocks(benchmark, block_bytes):
            tests = Tests.of(rows)
            if not len(tests.windows):
                continue
            if sent is not None:
                out = cut(out, "block")
                sent.destroy()
            sent = spark.sparkContext.broadcast(tests)
            out = out.mapInArrow(lambda bs, sent=sent: _pass(bs, sent.value, column), out.schema)
        tables.keep_last()
    return out if sent is not None else out.mapInArrow(lambda bs: _count(bs, column), out.schema)


def _count(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        yield _with_state(b, np.diff(words.of(*utf8(b.column(column)))[3]), *(b.column(k).to_pylist() for k in (-3, -2, -1)))


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row a document: words, words hit, items met, the number of longest verbatim matches, the words of the longest, and where
    that is, as item:place in the item:place in the document (of equal ones the first in the document, by item, in the item)."""
    m = matches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), benchmark, **how)
    n_hit = F.aggregate(F.transform("__hits", lambda x: x.end - x.start), F.lit(0).cast("long"), lambda a, x: a + x)
    best = F.array_min(F.transform("__matches", lambda x: F.struct((-x.length).alias("n"), x.start, F.coalesce(x["item"], F.lit("")).alias("item"), x["at"])))
    return m.withColumn("best", best).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(-F.col("best.n"), F.lit(0).cast("long")).alias("longest"),
        F.size("__matches").cast("long").alias("n_matches"),
        F.concat_ws(":", "best.item", F.col("best.at").cast("string"), F.col("best.start").cast("string")).alias("longest_at"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any test window, with all their columns; no shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    names[docs.columns.index("text")] = "text"
    return matches(docs.toDF(*names), benchmark, **how).where(F.size("__hits") == 0).select(names).toDF(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tests AS (SELECT q, item_id, i AS pos, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS win
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM tests),
places AS (SELECT r, s.n, i, array_to_string(w[i + 1:i + s.n], ' ') AS win FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM d) x, sizes s WHERE i + s.n <= len(w)),
hit AS (SELECT r, i, p.n, q, item_id, pos FROM places p JOIN tests t ON p.win = t.win AND p.n = t.n),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r),
runs AS (SELECT r, coalesce(item_id::VARCHAR, '') AS item, min(pos) AS pos, min(i) AS start, max(i + n) - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q, i - pos ORDER BY i) AS g FROM hit) GROUP BY r, q, item_id, i - pos, g),
best AS (SELECT r, count(*) AS n_matches, max(length) AS longest, arg_min(item || ':' || pos || ':' || start, (-length, start, item, pos)) AS longest_at FROM runs GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(longest_at, '') AS longest_at
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""

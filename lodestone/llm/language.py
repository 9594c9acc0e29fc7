"""Language identification with hyperdimensional profiles.

A letter's vector is a row of +1 and -1 that a hash of its code point gives; a 3-gram's is the product of its letters' vectors, each
rotated by its place (binding and permuting); a text's is the sum over its 3-grams (bundling), and a language's that over all
its texts.  The prediction is the language whose profile has the greatest cosine with the text's vector.

Text is lower-cased; whatever isn't a letter counts as a blank, and blanks in a row as one.  Every letter of every script has a
vector of its own, made where it is first needed.

Rows: null, empty or letterless texts are "und" with score 0, as are all texts where there is nothing to learn from; a null
id counts as held in; equal cosines go to the language first in order; very long texts are read whole, 3-gram vectors a bounded
number at once; repeated rows are counted and predicted each; other columns are ignored, but for lang_pred and score, which the
results replace; recognised() keeps even these.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

DIM = 1024
SEED = 7
POINT = 21  # bits of a code point; 0 is the blank
ROWS = 16_384  # 3-gram vectors held at once
LETTERS = 8192  # letter vectors held at once
COUNTED = 1 << 20  # 3-grams with counts that a learning task holds before they are merged or bundled


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Grams:
    """3-grams of texts, and their vectors, made where first needed."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.codes, self.letters = np.zeros(0, np.int64), np.zeros((3, 0, dim), np.int8)
        self.keys, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros((ROWS, dim), np.int8)

    @staticmethod
    def of(texts: Iterable) -> Iterator[tuple[int, np.ndarray]]:
        """Text number and 3-gram numbers, the texts with letters only; each text has a blank before and after it."""
        letter = _is_letter()
        for i, text in enumerate(texts):
            text = text.as_py() if isinstance(text, pa.Scalar) else text
            if text:
                s = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                s[~letter[s]] = 0
                keep = s > 0
                keep[1:] |= s[:-1] > 0
                keep[0] = True
                s = s[keep]
                if len(s) > 2:
                    yield i, (s[:-2] << 2 * POINT) | (s[1:-1] << POINT) | s[2:]

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the letters, adding those that aren't there; all are made anew where too many would be held."""
        new = np.setdiff1d(codes, self.codes)
        if len(new):
            if len(self.codes) + len(new) > LETTERS:
                self.codes, self.letters, new = self.codes[:0], self.letters[:, :0], np.unique(codes)
            words = -(-self.dim // 64)
            bits = mix((new.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(words, dtype=np.uint64)[None, :], self.seed)
            signs = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)[:, : self.dim].astype(np.int8) * 2 - 1
            made = np.stack([np.roll(signs, 2 - k, axis=1) for k in range(3)])
            order = np.argsort(np.append(self.codes, new), kind="stable")
            self.codes = np.append(self.codes, new)[order]
            self.letters = np.concatenate([self.letters, made], axis=1)[:, order]
        return np.searchsorted(self.codes, codes)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        low = (1 << POINT) - 1
        at = self._letters(np.concatenate([grams >> 2 * POINT, grams >> POINT & low, grams & low]))
        a, b, c = at[: len(grams)], at[len(grams) : 2 * len(grams)], at[2 * len(grams) :]
        return self.letters[0][a] * self.letters[1][b] * self.letters[2][c]

    def hold(self, grams: np.ndarray) -> None:
        """Makes the vectors of at most ROWS different 3-grams, in order, ready; the old ones go where there would be too many."""
        new = np.setdiff1d(grams, self.keys, assume_unique=True)
        if len(self.keys) + len(new) > ROWS:
            self.keys, self.rows, new = self.keys[:0], self.rows[:0], grams
        n = len(self.keys)
        at = np.searchsorted(self.keys, new)
        self.keys, self.rows = np.insert(self.keys, at, new), np.insert(self.rows, at, np.arange(n, n + len(new)))
        self.known[n : n + len(new)] = self.vectors(new)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of different 3-grams, times their counts."""
        out = np.zeros(self.dim, np.float64)
        for at in range(0, len(grams), ROWS):
            g, c = grams[at : at + ROWS], counts[at : at + ROWS]
            k = self._at(g)
            if k is None:
                self.hold(g)
                k = self._at(g)
            # Not @: its threads would wait busily in every one of an executor's workers.
            out += np.einsum("i,ij->j", c.astype(np.float32), self.known.take(k, axis=0).astype(np.float32))
        return out

    def _at(self, grams: np.ndarray) -> np.ndarray | None:
        """Rows of the 3-grams, if all are held."""
        if not len(self.keys):
            return None
        k = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return self.rows[k] if (self.keys[k] == grams).all() else None


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's different 3-grams, in order, and their counts."""
    g = np.sort(grams)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g[first], np.diff(np.append(first, len(g)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different 3-grams of several texts and their counts."""
    g, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g[first], np.add.reduceat(c, first)


def _bundled(held: dict[str, list], whole: dict[str, np.ndarray], made: Grams) -> None:
    """Adds counted 3-grams to the languages' profiles."""
    for lang, parts in held.items():
        grams, counts = _merged(parts)
        total = whole.setdefault(lang, np.zeros(made.dim, np.int64))
        for at in range(0, len(grams), 4096):
            total += counts[at : at + 4096] @ made.vectors(grams[at : at + 4096]).astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch], dim: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A partition's profile of each language: (lang, place, value).  Counts are bundled when there are COUNTED of all languages."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    whole: dict[str, np.ndarray] = {}
    made, size = Grams(dim, seed), 0
    for b in batches:
        langs = b.column(0).to_pylist()
        for i, g in Grams.of(b.column(1)):
            held.setdefault(langs[i], []).append(_distinct(g))
            size += len(held[langs[i]][-1][0])
            if size > COUNTED:
                held = {lang: [_merged(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > COUNTED // 2:
                    _bundled(held, whole, made)
                    held, size = {}, 0
    _bundled(held, whole, made)
    for lang, total in whole.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "place": np.arange(dim, dtype=np.int32), "value": total})


def profiles(labelled: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Profile by language, from all rows of (lang, text) with a lang.  Each partition sends its sums, so the shuffle has
    languages x dim rows a partition and the driver gets languages x dim numbers."""
    parts = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(lambda bs: _learn(bs, dim, seed), "lang string, place int, value long")
    rows = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", "v.value").collect()
    return {r.lang: np.array(r.value, np.float64) for r in sorted(rows, key=lambda r: r.lang)}


def _predicted(texts: pa.Array | list, grams: Grams, langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    best, score = ["und"] * len(texts), np.zeros(len(texts))
    for i, g in Grams.of(texts):
        v = grams.bundle(*_distinct(g))
        cosines = matrix @ v / max(np.linalg.norm(v), 1e-12)
        if len(langs):
            k = int(np.argmax(np.round(cosines, 9)))
            best[i], score[i] = langs[k], min(1.0, max(0.0, float(np.round(cosines[k], 9))))
    return best, score


def predict(docs: DataFrame, known: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    langs, column = list(known), docs.columns.index("text")
    matrix = np.array([v / max(np.linalg.norm(v), 1e-12) for v in known.values()]) if known else np.zeros((0, DIM))
    dim = matrix.shape[1]
    schema = docs.selectExpr("*", "'' lang_pred", "0D score").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dim, seed)
        for b in batches:
            best, score = _predicted(b.column(column), grams, langs, matrix)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, known: dict[str, np.ndarray], keep: Collection[str] | None = None, least: float = 0.0, seed: int = SEED) -> DataFrame:
    """The documents whose predicted language is one of `keep` (None: any that was learned) with a score of `least` or more, with all
    their columns as they are.  Where nothing was learned there is no ground to reject a text, and all with a letter stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    names[docs.columns.index("text")] = "text"
    rows = docs.toDF(*names)
    if not known:
        return rows.where(F.col("text").rlike(r"\p{L}")).toDF(*docs.columns)
    told = predict(rows, known, seed)
    wanted = F.col("lang_pred") != "und" if keep is None else F.col("lang_pred").isin(list(keep))
    return told.where(wanted & (F.col("lang_pred") != "und") & (F.col("score") >= least)).select(names).toDF(*docs.columns)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = profiles(docs.where(~held_out()))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), known).select("doc_id", "held_out", "lang_pred", "score")

"""Best-fit packing with certificates.

Texts become token ids in one pass and are cut into pieces of at most 1024.  Full pieces are sequences of their own.  The
rest is dealt evenly to partitions, each packed by best-fit decreasing; dual feasible functions bound from below the
sequences that a partition needs.  A partition that meets its bound is certified and done.  Those with a gap exchange pieces
(they are dealt anew among each other) and are packed again; a round counts only if it saves sequences.

Rows: a null text is empty and has the single id 2; a very long text is encoded whole in its task and makes many pieces; repeated
rows are packed each; null ids stay null; other columns are ignored; no documents, no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, table

SIZE = 1024
END = 2
HELD = 300_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids(dict):
    """Little-endian ids of each stretch between blanks, encoded where first met; emptied when it holds too many.

    The vocabulary's pattern joins text across a blank only where white space stands on both sides of it, or before it at the
    text's end; elsewhere a blank begins the stretch after it.  So a text without such a blank is the sum of its stretches;
    others are encoded whole.  A special token's name in a text is that token, and parts the text, as the tokenizers library has it.
    """

    def __init__(self, vocabulary: str, most: int = HELD):
        import tiktoken

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        _check(tokenizer)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(tokenizer), special_tokens={})
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most = most

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self.encode(stretch)
        if len(stretch) < 64:
            self[stretch] = out
        return out

    def of(self, text: str) -> bytes:
        if self.names and self.names.search(text):
            return b"".join(self.special[x] if i % 2 else self._plain(x) for i, x in enumerate(self.names.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text or JOINING.search(text):
            return self.encode(text)
        head, *rest = text.split(" ")
        return (self.encode(head) if head else b"") + b"".join(map(self.__getitem__, [" " + x for x in rest]))


# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A blank that the pattern may join with white space before it.
JOINING = re.compile(r"\s (?:\s|\Z)")


def _check(tokenizer) -> None:
    """ValueError unless the vocabulary's file asks for what Ids does: byte-level, by PATTERN, with nothing before or after."""
    asked = json.loads(tokenizer.to_str())
    first, model = asked["pre_tokenizer"] or {}, asked["model"]
    if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
        raise ValueError(f"the vocabulary splits texts in another way: {first}")
    if model.get("type") != "BPE" or asked["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        raise ValueError("the vocabulary isn't plain byte-level BPE")


def _ranks(tokenizer) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary and their ids, without its special tokens.  Its file writes bytes as printable
    characters: printable Latin-1 as itself, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(of_char[c] for c in k): v for k, v in tokenizer.get_vocab().items() if k not in special}


def _cut_up(batches: Iterator[pa.RecordBatch], vocabulary: str, held: int = HELD) -> Iterator[pa.RecordBatch]:
    ids, end = Ids(vocabulary, held), np.array([END], "<u4").tobytes()
    for b in batches:
        rows: list[tuple] = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = ids.of(text.as_py() or "") + end
            n = len(raw) // 4
            edges = [0, *range(n % SIZE or min(n, SIZE), n + 1, SIZE)]
            rows += [(key, i, s, e - s, zlib.crc32(raw[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(edges, edges[1:]))]
        yield batch(PIECES, **dict(zip(PIECES.names, zip(*rows) if rows else [[]] * 5)))


def pieces(docs: DataFrame, vocabulary: str | None = None, held: int = HELD) -> DataFrame:
    """Pieces of every text, in order: only the first may be shorter than 1024 ids.  held: encoded stretches that a task keeps, of about
    200 bytes each; more cost memory and save time."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(lambda bs: _cut_up(bs, vocabulary, held), DDL)


def lower_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """The best of the dual feasible functions: the plain sum, the thresholds f_e, and u_k for k up to 20."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int(count @ x) // size)
    for e in range(1, size // 2 + 1):
        f = np.where(x > size - e, size, np.where(x < e, 0, x))
        best = max(best, -(-int(count @ f) // size))
    for k in range(1, 21):  # u_k in units of 1 / (k * size), to stay whole
        whole = (k + 1) * x % size == 0
        u = np.where(whole, x * k, (k + 1) * x // size * size)
        best = max(best, -(-int(count @ u) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, by best-fit decreasing, and the number of bins.  A bit of `rooms` says which free spaces exist."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, k, n = size, n, n + 1
        bins[i], offsets[i] = k, size - room
        left = room - need
        if left:
            free[left].append(k)
            rooms |= 1 << left
    return bins, offsets, n


def _pack_part(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("rid", kind="stable", ignore_index=True)
    lengths = part["length"].to_numpy()
    bins, offsets, n = best_fit(lengths)
    return part.assign(bin=bins, offset=offsets, n_bins=n, gap=n - lower_bound(lengths))


PACKED = DDL + ", rid long, part long, bin long, offset long, n_bins long, gap long"


def _round(rows: DataFrame, n: int, part_items: int, seed: int) -> DataFrame:
    """Deal the rows evenly to partitions and pack each."""
    dealt = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "rid", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(-(-n // part_items))).alias("part"))
    return cut(dealt.groupBy("part").applyInPandas(_pack_part, PACKED), f"packed-{seed}")


def pack(cut_up: DataFrame, part_items: int = 16_384, rounds: int = 3) -> DataFrame:
    """sequence_id and offset for each piece (columns of pieces(), read from a written table).  part_items bounds a partition; rounds the exchanges."""
    numbered = cut_up.withColumn("rid", F.monotonically_increasing_id())
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = numbered.where(F.col("length") == SIZE).select(*own, (2 * F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = numbered.where(F.col("length") < SIZE)
    bins = lambda df: df.where("bin = 0 and offset = 0").agg(F.sum("n_bins")).first()[0] or 0
    done = lambda df, seed: df.select(*own, (2 * ((F.lit(seed).cast("long") * 2**30 + F.col("part")) * 2**28 + F.col("bin")) + 1).alias("sequence_id"), "offset")
    n = rows.count()
    if not n:
        return out
    packed, seed = _round(rows, n, part_items, 0), 0
    for again in range(1, rounds + 1):
        open_rows = packed.where("gap > 0")
        m = open_rows.count()
        # Exchanging among fewer, fuller partitions closes gaps that the dealing made; one partition has nobody to exchange with.
        if not m or open_rows.select("part").distinct().limit(2).count() < 2:
            break
        new = _round(open_rows, m, 2 * part_items, again)
        if bins(new) >= bins(open_rows):
            break
        out = out.unionByName(done(packed.where("gap <= 0"), seed))
        packed, seed = new, again
    return out.unionByName(done(packed, seed))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(table(spark, sf_dir, "documents"), held=2 * HELD), "pieces"))

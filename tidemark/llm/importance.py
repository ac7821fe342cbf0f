"""Importance resampling towards a target, over hashed runs of words, with segments counted once.

A text is cut at its newlines, which no word holds. Each different line is looked at once: its words, its runs of one to
three words, and their buckets are stored, and count as often as the line occurs. Runs that go over a line's end belong to
their document and are added to these. From the counts of corpus and target follow the gains of the buckets; a line's
weight is the sum of its gains, computed once and joined to all its places, and a document's weight is that of its lines
and of its runs across lines. Documents are drawn by weight with Gumbel noise from their ids, which is sampling without
replacement.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A bucket is the unsigned crc32 of the run's
UTF-8 bytes (words joined by one space), modulo BUCKETS. A run's crc is put together from those of its words.

Defined results: null and empty texts have no words, weight 0 and are not drawn; repeated rows count each and get a row
each; a null id hashes as the empty string and ties after all others; other columns are ignored; an empty target or corpus
counts 0 everywhere; empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, text_or_empty
from tidemark.llm.kernels import NOT_ALNUM, bytes_of, slices, words
from tidemark.operators.scan import ranked
from tidemark.shared import stored

BUCKETS = 10_000
HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of up to this many bytes get their crc from one table.
SHORT = 64


def _zero_byte() -> np.ndarray:
    """What a zero byte makes of a crc's low byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


def _then_zeros() -> list[np.ndarray]:
    """tables[k][j][b]: what 2^k zero bytes make of byte j of a crc being b."""
    byte, places = np.arange(256, dtype=np.uint32), np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8)
    x = byte[None, :] << places
    tables = [(x >> np.uint32(8)) ^ _zero_byte()[x & np.uint32(255)]]
    while len(tables) < 31:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for j in (1, 2, 3):
        out = out ^ table[j][(crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


_ZEROS = _then_zeros()
_AFTER = [_zero_byte()]  # a byte's share in the crc when so many bytes follow it
while len(_AFTER) < SHORT:
    _AFTER.append(_apply(_ZEROS[0], _AFTER[-1]))
_AFTER = np.stack(_AFTER)
_NONE = np.array([zlib.crc32(bytes(n)) for n in range(SHORT + 1)], np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))


def followed(crc: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crcs of texts made of one of crc `crc` and one of crc `more` and so many bytes."""
    left, k = lengths.copy(), 0
    while left.any():
        odd = (left & 1).astype(bool)
        crc = np.where(odd, _apply(_ZEROS[k], crc), crc)
        left, k = left >> 1, k + 1
    return crc ^ more


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for each word, in ascending order of start."""
    length = end - start
    if not len(start):
        return np.zeros(0, np.uint32)
    n = length.sum()
    first = np.cumsum(length) - length
    at = np.arange(n) - np.repeat(first - start, length)
    rest = np.repeat(end, length) - at - 1
    crc = np.bitwise_xor.reduceat(_AFTER[np.minimum(rest, SHORT - 1), data[at]], first)
    # Known crcs of zero bytes bring in how a crc begins and ends.
    crc = crc ^ _NONE[np.minimum(length, SHORT)]
    for i in np.flatnonzero(length > SHORT):
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return crc


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(texts: pa.Array, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, bucket) of the runs of one to three words of each text, and each text's number of words. across: only runs
    over a line's end."""
    w = words(texts, NOT_ALNUM, lower=True)
    data, _ = bytes_of(texts)
    data = _LOWER[data]
    n = len(w.doc)
    length, doc, starts, ends = w.length, w.doc, w.start, w.end
    same = [np.zeros(0, bool)] * 3
    for k in (1, 2):
        same[k] = np.zeros(n, bool)
        same[k][: max(0, n - k)] = doc[k:] == doc[: max(0, n - k)]
    if across:
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        for k in (1, 2):
            same[k][: max(0, n - k)] &= line[k:] != line[: max(0, n - k)]
    two, three = np.flatnonzero(same[1]), np.flatnonzero(same[2])
    needed = np.zeros(n + 2, bool)
    for shift in (0, 1):
        needed[two + shift] = True
    for shift in (0, 1, 2):
        needed[three + shift] = True
    crc = np.zeros(n, np.uint32)
    pick = np.flatnonzero(needed[:n]) if across else np.arange(n)
    crc[pick] = word_crcs(data, starts[pick], ends[pick])
    joined = lambda a, i: followed(followed(a, _SPACE, np.ones(len(i), np.int64)), crc[i], length[i])
    pairs = joined(crc[two], two + 1)
    triples = joined(joined(crc[three], three + 1), three + 2)
    own = np.zeros(0, np.int64) if across else np.arange(n)
    where = np.concatenate([doc[own], doc[two], doc[three]])
    bucket = (np.concatenate([crc[own], pairs, triples]) % BUCKETS).astype(np.uint16)
    order = np.argsort(where, kind="stable")
    return where[order], bucket[order], w.counts


def _with_buckets(column: str, across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches in which `column`, a text, gives way to its number of words and its runs' buckets, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                doc, bucket, counts = _runs(part.column(column), across)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)) * 2
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(bucket.astype("<u2").tobytes())])
                kept = [c for c in part.schema.names if c != column]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(counts.astype(np.int64)), data.cast(pa.binary())], names=[*kept, "n_words", "buckets"])

    return run


def _buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows, and the row of each."""
    data, offsets = bytes_of_binary(column)
    return np.frombuffer(data, "<u2"), np.repeat(np.arange(len(column)), np.diff(offsets) // 2)


def bytes_of_binary(column: pa.Array) -> tuple[bytes, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task: how often it occurs, a row's buckets counting n times."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "buckets"):
            bucket, row = _buckets_of(part.column("buckets"))
            total += np.bincount(bucket, part.column("n").to_numpy()[row], BUCKETS).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def _weights(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches in which a row's buckets give way to the sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "buckets"):
                bucket, row = _buckets_of(part.column("buckets"))
                before = np.append(0, np.cumsum(gains[bucket]))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                kept = [c for c in part.schema.names if c != "buckets"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(before[ends[1:]] - before[ends[:-1]])], names=[*kept, "weight"])

    return run


class Segments:
    """The stored runs of a table of texts: those of each different line, and those over line ends of each row."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, label: str):
        self.docs, self.text_col = docs, text_col
        self.key = row_key(id_col, text_col).alias("dk")
        lines = self.lines("line").groupBy("line").agg(F.count(F.lit(1)).alias("n")).select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"), "n", "line")
        self.each = stored(lines.mapInArrow(_with_buckets("line", False), "h binary, n long, n_words long, buckets binary"), f"{label}-lines")
        rows = docs.select(self.key, F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
        self.columns = f"dk binary, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long"
        self.rows = stored(rows.mapInArrow(_with_buckets("text", True), f"{self.columns}, buckets binary"), f"{label}-rows")

    def lines(self, out: str, *more: F.Column) -> DataFrame:
        """The lines that hold a word, one row for each of their places."""
        return self.docs.select(*more, F.explode(F.split(text_or_empty(self.text_col), "\n", -1)).alias(out)).where(F.col(out).rlike(HAS_WORD))

    def counts(self) -> DataFrame:
        """(bucket, n) over all rows."""
        every = self.each.select("buckets", "n").union(self.rows.select("buckets", F.lit(1).cast("long")))
        return every.mapInArrow(_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def weights(self, gains: np.ndarray) -> DataFrame:
        """(doc_id, n_words, weight) of every row."""
        line = self.each.select("h", "buckets").mapInArrow(_weights(gains), "h binary, weight long")
        places = self.lines("line", self.key).select("dk", F.unhex(F.md5(F.col("line").cast("binary"))).alias("of"))
        of_lines = places.join(line, places["of"] == line["h"]).groupBy("dk").agg(F.sum("weight").alias("of_lines"))
        own = self.rows.mapInArrow(_weights(gains), f"{self.columns}, weight long")
        # Rows of one id and text share a key: each of them has its part of the key's lines.
        keys = own.groupBy("dk").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("weight").alias("across"))
        joined = keys.join(of_lines, "dk", "left").withColumn("weight", F.col("across") + F.expr("coalesce(of_lines, 0L) div copies"))
        return joined.select("doc_id", "n_words", "weight", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, from its counts in corpus and target: BUCKETS numbers, whatever the size of the corpus."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))
    all_s, all_t = float(sum(s.values()) + BUCKETS), float(sum(t.values()) + BUCKETS)
    return np.array([floor(1000 * log(float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t))) for b in range(BUCKETS)], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row of docs. Of those with `least_words` words
    or more, `percent` of a hundred are drawn."""
    corpus, aim = Segments(docs, id_col, text_col, "corpus"), Segments(target, target_id, target_text, "target")
    rows = corpus.weights(bucket_gains(corpus.counts(), aim.counts()))
    n = F.col("n_words")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    rows = rows.select("doc_id", (n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).alias("n_features"), "weight", (F.col("weight") + noise).cast("long").alias("score"), (n >= least_words).alias("able"))
    placed = ranked(rows, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place", label="importance")
    most = corpus.rows.where(n >= least_words).count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= most), F.col("place")).cast("long").alias("rank"))

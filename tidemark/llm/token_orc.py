"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id (equal ids by their text's hash, then by row, so that no id is one task), tokenized
in Arrow batches and written by Spark's ORC writer in ascending id order. ORC stores the ids as run-length encoded
integers; each stripe and row group has minimum, maximum and a Bloom filter of doc_id, so readers split a file by stripes
and skip those that can't hold a wanted id. Each row holds the number of its range and its place there.

Texts are cut, over the bytes of the Arrow column, where the byte-level split never bridges: at single spaces between
characters that are not white space, between an ASCII letter and a mark, and around single newlines; never at characters
that the tokenizer's added tokens have. The different pieces of a slice are found by Arrow's dictionary encoding, each is
encoded once by the tokenizers library and kept in a bounded table of the worker, and ids are gathered by index. Texts
for a tokenizer with another split are not cut.

Defined results: null or empty text is only the end id; documents with equal ids stand in order of their text's hash; null
ids come first; repeated rows each have a row; other columns are ignored; empty input writes no ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.kernels import bytes_of, slices
from tidemark.shared import stored, work_dir

END_ID = 0
_PIECES: dict[str, dict[bytes, bytes]] = {}
_LIBRARY: dict[str, "Library"] = {}
#: Entries of a worker's table of pieces, and bytes of a piece that it keeps.
TABLE_ENTRIES, PIECE_BYTES = 1_000_000, 64


def _bytes(*values: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


# ASCII white space and separators; first bytes of characters among which the other white space is; its last two bytes.
_BLANK = _bytes(9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
_MAY_BLANK = _BLANK | _bytes(0xC2, 0xE1, 0xE2, 0xE3)
_LAST, _BEFORE_LAST = _bytes(*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF), _bytes(0xC2, 0x80, 0x81, 0x9A)
_LETTER = _bytes(*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_VISIBLE = _bytes(*range(33, 127))
_MARK = _VISIBLE & ~_LETTER & ~_bytes(*b"0123456789")


class Library:
    """A tokenizer of the library, and what of its vocabulary the cutting needs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            rules = json.load(f)
        split = rules.get("pre_tokenizer") or {}
        added = b"".join(t["content"].encode() for t in rules.get("added_tokens", ()))
        self.free = ~_bytes(*added)
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not rules.get("normalizer") and self.free[32] and self.free[10]
        # The tokens of a byte-level vocabulary have a character for each byte.
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, known: dict[bytes, bytes], new: list[bytes]) -> None:
        """Adds the ids of new pieces, as little-endian 32-bit integers."""
        spaced, lines = [], []
        for p in new if self.cuts else ():
            if p[0] == 32 and len(p) > 1:
                if not _MAY_BLANK[p[1]] and _VISIBLE[p[-1]]:
                    spaced.append(p)
            elif _VISIBLE[p[0]] and _VISIBLE[p[-1]]:
                lines.append(p)
        # Many pieces in one text, cut again by the bytes that each id stands for. Newlines are ids of their own.
        for pieces, between in ((spaced, b""), (lines, b"\n")):
            for a in range(0, len(pieces), 2000):
                some = pieces[a : a + 2000]
                ids = self.ids([b"".join([between + p for p in some])])[0]
                ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p) + len(between) for p in some])) + 1
                raw, before = ids.tobytes(), 0
                for p, end in zip(some, (ends * 4).tolist()):
                    known[p] = raw[before + 4 * len(between) : end]
                    before = end
        rest = [p for p in new if p not in known]
        for p, ids in zip(rest, self.ids(rest)):
            known[p] = ids.tobytes()


def piece_starts(data: np.ndarray, offsets: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Where pieces start in the documents' joined bytes: at documents, and at places that are certain borders of tokens.
    free: bytes that no added token has."""
    n = len(data)
    starts = np.zeros(n + 1, bool)
    starts[offsets] = True
    edge = np.flatnonzero(starts)
    kind = (_LETTER * 1 + (_MARK & free) * 2).astype(np.uint8)[data]
    mark = np.zeros(n + 1, bool)
    mark[1:n] = (kind[:-1] == 1) & (kind[1:] == 2)
    for what in (32, 10):
        at = np.flatnonzero(data[1 : n - 1] == what) + 1
        before, after = data[at - 1], data[at + 1]
        if what == 32:
            other = _LAST[before] & _BEFORE_LAST[data[np.maximum(at - 2, 0)]]
            at = at[~(_MAY_BLANK[after] | _BLANK[before] | other | starts[at + 1])]
        else:
            at = at[_VISIBLE[after] & _VISIBLE[before] & ~starts[at + 1] & ~starts[at]]
            mark[at + 1] = True
        mark[at] = True
    mark[edge] = True
    return np.flatnonzero(mark[:n])


def encode_texts(path: str, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, as the library gives for the whole text, and the end id."""
    if path not in _LIBRARY:
        _LIBRARY[path] = Library(path)
    library = _LIBRARY[path]
    data, offsets = bytes_of(texts)
    docs = len(offsets) - 1
    starts = piece_starts(data, offsets, library.free) if library.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
    bounds = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    different, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
    known = _PIECES.setdefault(path, {})
    if len(known) > TABLE_ENTRIES:
        known.clear()
    new = [p for p in different if p not in known]
    if new:
        library.learn(known, new)
    found = [known[p] for p in different]
    for p in new:
        if len(p) > PIECE_BYTES:
            del known[p]
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    pool = np.frombuffer(b"".join(found), "<i4")
    count = size[which]
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.cumsum(np.bincount(doc, count, docs).astype(np.int64) + 1)
    flat = np.full(ends[-1] if docs else 0, END_ID, np.int32)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    shift = (np.cumsum(size) - size)[which] - (np.cumsum(count) - count)
    flat[inner] = pool[np.repeat(shift, count) + np.arange(len(flat) - docs)]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, stripe_mb: int = 16) -> None:
    """Writes (doc_id, part, ord, ids) as ORC: rows in ascending order of part, then ord, ascend by id. tokenizer: path of
    a tokenizers JSON file, readable on every executor."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        order, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                n = part.num_rows
                columns = [part.column("doc_id"), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(order, order + n)), encode_texts(tokenizer, part.column("text"))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "ord", "ids"])
                order += n

    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = ["doc_id", "of_text", "row"]
    placed = rows.withColumns({"of_text": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_mb << 20), "compression": "snappy"}
    placed.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, ord long, ids array<int>").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, ord, ids); filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, ord long, ids array<int>").orc(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only numbers are shuffled; the running sum is within a range, on top of the sums of the ranges before it (a table of
    one row per range).
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            at = at - at[0]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("ord"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "ord", "n_tokens", "ids_crc32"])

    # Read once: both the ranges' sums and the rows come from this table of numbers.
    rows = stored(tokens.mapInArrow(digest, "doc_id long, part int, ord long, n_tokens long, ids_crc32 long"), "digests")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.withColumn("base", F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("part").alias("of"), "base")
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("within", within)
    return placed.join(parts, placed["part"] == parts["of"]).select("doc_id", (F.col("base") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents into the shared folder, and returns the digests read back from there."""
    spark = docs.sparkSession
    path = work_dir(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return token_digests(read_tokens(spark, path))

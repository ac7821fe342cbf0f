"""Numpy kernels over Arrow string columns: word tables, rolling hashes, windows. They work on slices of a few MB, so that
a task's memory does not follow the Arrow batch, and never build Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(7)
#: A byte's place within its word weighs by a random odd number: that of its lower 12 bits times that of the rest.
_PLACE = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = np.append(np.uint64(1), _rng.integers(0, 2**63, 1 << 19, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: True: the byte separates words. Bytes of non-ASCII characters always belong to words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows whose text has about `most` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """The words of some documents in order. doc: index of the document; first: index of each document's first word;
    start, end: bytes of each word within the documents' joined text."""

    n_docs: int
    doc: np.ndarray
    hash: np.ndarray
    length: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, offsets = bytes_of(texts)
    n, docs = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(docs, none, np.zeros(0, np.uint64), none, np.zeros(docs, np.int64), np.zeros(docs, np.int64), none, none)
    word = ~separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(doc, minlength=docs)
    h = np.zeros(0, np.uint64)
    if len(starts):
        table = (_BYTE_LOWER if lower else _BYTE).copy()
        table[separators] = 0
        values = table[data[starts[0] :]]
        place = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, n)))
        values *= _PLACE[place & 4095]
        if (ends - starts).max() > 4096:
            values *= _BLOCK[place >> 12]
        h = mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))
    return Words(docs, doc, h, ends - starts, counts, np.cumsum(counts) - counts, starts, ends)


def grams(w: Words, k: int) -> np.ndarray:
    """A hash of the k words from each word on; meaningless where they pass the end of the document."""
    out = np.zeros(len(w.hash), np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out *= step
        out[: max(0, len(out) - j)] += w.hash[j:]
    return mix(out)


def whole(w: Words, k: int) -> np.ndarray:
    """Where k words from here on lie in one document."""
    ends = (w.first + w.counts)[w.doc]
    return np.arange(len(w.doc)) + k <= ends


def sliding(x: np.ndarray, k: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i : i + k] for every i; beyond the end stands fill."""
    def shifted(y: np.ndarray, by: int) -> np.ndarray:
        z = np.full_like(y, fill)
        if by < len(y):
            z[: len(y) - by] = y[by:]
        return z

    out, size = x, 1
    while size * 2 <= k:
        out, size = op(out, shifted(out, size)), size * 2
    return op(out, shifted(out, k - size)) if size < k else out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the half-open spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0

"""Quality rules on repetition inside a document, from its suffix array.

A suffix array over the words of all documents of a slice (documents apart) is built by prefix doubling that sorts anew
only suffixes which still tie. The longest common prefixes of neighbours come from the ranks of each doubling. Where a
prefix interval is at least `min_repeat` words long, its substring is a maximal repeat; the spans of all repeats are
united. A document is rejected by the base rules, or when the united spans cover more than `max_covered` of its words, or
when its longest repeat is over `max_repeat` words.

One narrow pass without shuffle. Words are runs of characters other than ASCII white space, compared by a 64-bit hash.

Defined results: null or empty text has no words and fails (n_words < 50); repeated rows and null ids give a row each; a
repeat that overlaps itself counts its places once; other columns are kept; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import SPACE, Words, bytes_of, covered, slices, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True


def longest_repeats(w: Words) -> np.ndarray:
    """For each word: the most words from it on that also stand elsewhere in its document."""
    n = len(w.hash)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    code = np.unique(w.hash, return_inverse=True)[1].astype(np.int64)
    key = w.doc * (code.max() + 1) + code
    suffix = np.argsort(key, kind="stable")
    ends = (w.first + w.counts)[w.doc]
    rank = np.empty(n, np.int64)
    new = np.append(True, np.diff(key[suffix]) != 0)
    rank[suffix] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(tied):
        at = suffix[tied]
        nxt = at + step
        second = np.where(nxt < ends[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[at] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        suffix[tied], key = at[order], key[order]
        new = np.append(True, np.diff(key) != 0)
        rank[suffix[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank.astype(np.int32))
        tied = tied[~new | ~np.append(new[1:], True)]
        step *= 2
    a, b = suffix[:-1], suffix[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < ends[a]) & (y < ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += (ok & (levels[level][x] == levels[level][y])) << level
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def _sum_by(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(x, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    data, offsets = bytes_of(texts)
    w = words(texts, SPACE)
    docs = w.n_docs
    longest = longest_repeats(w)
    by_word = np.append(w.first, len(w.hash))
    lines = words(texts, _NOT_NEWLINE)
    spaces = np.append(0, np.cumsum(~SPACE[data], dtype=np.int64))
    full = spaces[lines.end] > spaces[lines.start] if len(lines.start) else np.zeros(0, bool)
    doc, line = lines.doc[full], lines.hash[full]
    order = np.lexsort((line, doc))
    doc, line = doc[order], line[order]
    again = np.append(False, (np.diff(doc) == 0) & (line[1:] == line[:-1]))[: len(doc)]
    at = np.arange(len(longest))

    def spans(least: int, length: np.ndarray | int) -> np.ndarray:
        far = longest >= least
        return _sum_by(covered(at[far], (at + length)[far], len(at)), by_word)

    top = np.zeros(docs, np.int64)
    np.maximum.at(top, w.doc, longest)
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": _sum_by(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sum_by(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(doc[again], minlength=docs).astype(np.int64),
        "n_repeat_words": spans(3, 3),
        "covered_words": spans(min_repeat, longest),
        "longest_repeat": top,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, min_repeat: int = 5, max_covered: float = 0.4, max_repeat: int = 100, keep_columns: bool = False) -> DataFrame:
    """One row per document: the measures above, base_failed and kept. keep_columns: after all columns of docs."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]
    if keep_columns:
        rows = docs.drop(*names)
        rows = rows.withColumn("__text", F.col(f"`{text_col}`"))
    else:
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    kept_schema = [f for f in rows.schema.fields if f.name != "__text"]
    fields = ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'long'}" for n in names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                m = measure(part.column("__text"), min_repeat)
                base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~base & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
                old = [part.column(f.name) for f in kept_schema]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(m[n]) for n in names[:-2]), pa.array(base), pa.array(kept)], names=[*(f.name for f in kept_schema), *names])

    return rows.mapInArrow(run, schema)

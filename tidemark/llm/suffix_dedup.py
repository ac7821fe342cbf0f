"""Repeated passages across documents, from a sparse suffix array.

Suffixes are kept only at minimiser positions, chosen by content: in every run of `window` consecutive k-grams of words,
the one with the least hash. With k + window - 1 = `min_words`, each passage of min_words words has one, at the same place
in each of its copies. A kept suffix carries the hash of its k words, a code of each of the `window` - 1 words after them
for its order, and a 64-bit hash of all its words from `window` - 1 places before to as many after, which is as far as a
match reaches until the next kept suffix takes over.

The suffixes are range-partitioned and sorted by their words, so that a passage that is in very many documents spreads
over tasks by what follows it. Neighbours are compared. Of equal whole suffixes in different documents all carried words
are a match. Others tell how far to the right a match with any suffix can reach at most; for these the texts are read
again, and the match is extended to both sides by the hashes of the runs of min_words words around the k-gram that the
bound allows: a run that several documents have is a match. The first and last suffix of a partition, whose neighbours
stand elsewhere, are always extended. So every passage of min_words words or more is found, and no word counts that is
not equal by a 64-bit hash. The spans of a document are united.

Before the shuffle each slice of a task settles what it can: a suffix whose whole carried text also stands in another
document of the slice is a match already, and only two of each such group go on, of different documents. So a group of
copies sends a few rows per task however large it is, and the sort is never fed a hot group.

Words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Defined results: null or empty text has no
words and no spans; repeated rows (same id and text) are one document; null ids get rows with a null id; ties need no
order, equal suffixes match each other; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, text_or_empty
from tidemark.llm.kernels import NOT_ALNUM, Words, grams, mix, slices, sliding, whole, words
from tidemark.shared import stored

_MOST = np.iinfo(np.uint64).max
_ODD = np.random.default_rng(13).integers(0, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimisers(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k-gram hashes) of the kept suffixes."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(w, k)
    fit = whole(w, k)
    g[~fit] = _MOST
    least = sliding(g, window, np.minimum, _MOST)
    least[~whole(w, k + window - 1)] = 0
    # g[p] is the least of some whole window that starts in [p - window + 1, p]
    back = sliding(np.append(np.zeros(window - 1, np.uint64), least), window, np.maximum, 0)[:n]
    at = np.flatnonzero(fit & (back == g) & (g > 0))
    return at, g[at]


def contexts(w: Words, at: np.ndarray, h: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(a byte for each of the `reach` words after each k-gram, 0 beyond the document; the hash of all words around it)."""
    end, begin = (w.first + w.counts)[w.doc[at]], w.first[w.doc[at]]
    after = np.zeros((len(at), reach), np.uint8)
    whole_hash = h.copy()
    last = len(w.hash) - 1
    for j in range(reach):
        left, right = at - 1 - j, at + k + j
        whole_hash += np.where(left >= begin, w.hash[np.maximum(left, 0)], np.uint64(1)) * _ODD[0, j]
        there = w.hash[np.minimum(right, last)]
        whole_hash += np.where(right < end, there, np.uint64(1)) * _ODD[1, j]
        after[:, j] = np.where(right < end, np.maximum(there >> np.uint64(56), np.uint64(1)), 0)
    return after, mix(whole_hash)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading words of each row; 0 is the end of a document and equals nothing."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(1)


def _first_two(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each group the first row and the first row of another document."""
    _, first, which = np.unique(group, return_index=True, return_inverse=True)
    other = np.flatnonzero(doc != doc[first[which]])
    return np.concatenate([first, other[np.unique(group[other], return_index=True)[1]]])


def _united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, overlapping ones joined. Rows come in order of document and start."""
    if not len(doc):
        return doc, start, end
    base = doc * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.append(True, (base + start)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix of bytes as binary values."""
    size = x.shape[1]
    offsets = np.arange(0, (len(x) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


SEED_SCHEMA = "dk binary, doc_id long, n_words long, h long, pos long, until long, after binary, full long, settled boolean"
FOUND_SCHEMA = "dk binary, doc_id long, n_words long, start long, end long, right int"
RUN_SCHEMA = "dk binary, doc_id long, n_words long, start long, key long"
FOUND = ["dk", "doc_id", "n_words", "start", "end", "right"]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, k: int = 26) -> DataFrame:
    """One row per document: doc_id, n_words, repeated_words (covered by passages of at least min_words words that other
    documents have too), n_spans, longest_span, and spans (array of start and end, in words from 0)."""
    window = min_words - k + 1
    reach = window - 1

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                w = words(part.column("text"), NOT_ALNUM, lower=True)
                at, g = minimisers(w, k, window)
                if len(at):
                    after, full = contexts(w, at, g, k, reach)
                    doc = w.doc[at]
                    pos = at - w.first[doc]
                    start, end = pos - np.minimum(pos, reach), np.minimum(pos + k + reach, w.counts[doc])
                    _, group, size = np.unique(full, return_inverse=True, return_counts=True)
                    first = np.full(len(size), np.iinfo(np.int64).max)
                    np.minimum.at(first, group, doc)
                    other = np.zeros(len(size), bool)
                    np.logical_or.at(other, group, doc != first[group])
                    done = other[group] & (end - start >= min_words)
                    lead = np.zeros(len(at), bool)  # two suffixes of each settled group go on
                    lead[_first_two(group, doc)] = True
                    spans = _united(doc[done], start[done], end[done])
                    yield record(part, w, *spans)
                    on = np.flatnonzero(~done | lead)
                    yield record(part, w, doc[on], pos[on], np.zeros(len(on), np.int64), g[on].view(np.int64), after[on], full[on].view(np.int64))
                none = np.zeros(part.num_rows, np.int64)
                yield record(part, w, np.arange(part.num_rows), none, none)

    def record(part: pa.RecordBatch, w: Words, doc: np.ndarray, pos: np.ndarray, until: np.ndarray, h: np.ndarray | None = None, after: np.ndarray | None = None, full: np.ndarray | None = None) -> pa.RecordBatch:
        which, n = pa.array(doc.astype(np.int64)), len(doc)
        suffix = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())] if h is None else [_binary(after), pa.array(full)]
        columns = [part.column("dk").take(which), part.column("doc_id").take(which), pa.array(w.counts[doc].astype(np.int64)), pa.nulls(n, pa.int64()) if h is None else pa.array(h), pa.array(pos.astype(np.int64)), pa.array(until.astype(np.int64)), *suffix, pa.array(np.full(n, h is None))]
        return pa.RecordBatch.from_arrays(columns, names=["dk", "doc_id", "n_words", "h", "pos", "until", "after", "full", "settled"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(table: pa.Table, begins: bool, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            """begins, last: whether no row of the partition stands before, or after, those of the table."""
            table = table.combine_chunks()
            n = table.num_rows
            h, full, pos, words_ = (table[c].to_numpy() for c in ("h", "full", "pos", "n_words"))
            dk = np.unique(np.array(table["dk"].to_pylist(), "S16"), return_inverse=True)[1]
            after = np.frombuffer(b"".join(table["after"].to_pylist()), np.uint8).reshape(n, reach)
            starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (full[1:] != full[:-1])))
            text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            # How far a match with a different text can reach to the right, -1 where no other has the k-gram
            right = np.full(len(starts), -1)
            near = np.flatnonzero(h[starts[1:]] == h[starts[:-1]])
            reached = _common(after[starts[near]], after[starts[near + 1]])
            np.maximum.at(right, near, reached)
            np.maximum.at(right, near + 1, reached)
            right[0], right[-1] = reach if begins else right[0], reach if last else right[-1]
            ends = np.append(starts[1:], n) - 1
            several = (dk[starts] != dk[ends])[text]
            start, end = pos - np.minimum(pos, reach), np.minimum(pos + k + reach, words_)
            hit = np.flatnonzero(several & (end - start >= min_words))
            loose = _first_two(text, dk)
            loose = loose[right[text[loose]] >= 0]
            which = pa.array(np.append(hit, loose))
            bound = pa.array(np.append(np.zeros(len(hit), np.int32), right[text[loose]].astype(np.int32)), mask=np.append(np.ones(len(hit), bool), np.zeros(len(loose), bool)))
            out = pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(which) for c in ("dk", "doc_id", "n_words")), pa.array(np.append(start[hit], pos[loose])), pa.array(np.append(end[hit], pos[loose])), bound], names=FOUND)
            if last:
                return out, None
            # The last text may go on in rows to come. Rows told twice only give the same spans again.
            a = int(starts[-1])
            return out, pa.concat_tables([table.slice(a, 1), table.slice(n - 1)]) if several[-1] else table.slice(a)

        held, begins = None, True  # the last rows, of which the next batch may have neighbours
        for batch in batches:
            settled = batch.column("settled")
            done = batch.filter(settled)
            yield pa.RecordBatch.from_arrays([*(done.column(c) for c in ("dk", "doc_id", "n_words", "pos", "until")), pa.nulls(done.num_rows, pa.int32())], names=FOUND)
            rest = batch.filter(pa.compute.invert(settled))
            if rest.num_rows:
                table = pa.Table.from_batches([rest])
                out, held = spans(table if held is None else pa.concat_tables([held, table]), begins, False)
                begins = False
                yield out
        if held is not None:
            yield spans(held, begins, True)[0]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), NOT_ALNUM, lower=True)
                lists = part.column("at")
                doc = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy())
                pos, right = (lists.flatten().field(i).to_numpy() for i in (0, 1))
                back = np.arange(window)  # words of a run before the k-gram
                start = pos[:, None] - back
                fit = (start >= 0) & (start + min_words <= w.counts[doc][:, None]) & (reach - back <= right[:, None])
                at = np.unique((w.first[doc][:, None] + start)[fit])
                which = pa.array(w.doc[at])
                columns = [*(part.column(c).take(which) for c in ("dk", "doc_id")), pa.array(w.counts[w.doc[at]].astype(np.int64)), pa.array(at - w.first[w.doc[at]]), pa.array(grams(w, min_words)[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["dk", "doc_id", "n_words", "start", "key"])

    rows = docs.select(row_key(id_col, text_col).alias("dk"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    suffixes = rows.mapInArrow(seeds, SEED_SCHEMA)
    # Settled spans travel by document, suffixes by their first words and what follows them.
    placed = suffixes.withColumn("h", F.coalesce("h", F.xxhash64("dk"))).repartitionByRange("h", "after", "full").sortWithinPartitions("settled", "h", "after", "full", "dk")
    found = stored(placed.mapInArrow(compare, FOUND_SCHEMA), "found")
    loose = found.where("right is not null").groupBy("dk").agg(F.collect_list(F.struct("start", "right")).alias("at"))
    runs = stored(rows.join(loose, "dk").select("dk", "doc_id", "text", "at").mapInArrow(extend, RUN_SCHEMA), "runs")
    repeated = runs.groupBy("key").agg(F.min(F.xxhash64("dk")).alias("low"), F.max(F.xxhash64("dk")).alias("high")).where("low <> high").select("key")
    more = runs.join(repeated, "key").select("dk", "doc_id", "n_words", "start", (F.col("start") + min_words).alias("end"))
    found = found.where("right is null").drop("right").union(more)

    by = Window.partitionBy("dk").orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("dk", "island").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"))
    real = F.col("end") > F.col("start")
    span = F.when(real, F.struct("start", "end"))
    return islands.groupBy("dk").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum(F.when(real, F.col("end") - F.col("start")).otherwise(0)).alias("repeated_words"), F.count(span).alias("n_spans"), F.max(F.col("end") - F.col("start")).alias("longest_span"), F.array_sort(F.collect_list(span)).alias("spans")).drop("dk")

"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of words, over all documents, in a table of 2^20 hash buckets: of fixed size, whatever the corpus.
2. A document is a weighted set of 5-word shingles: count x (1 + damping x mean IDF of the five words, scaled to 0..1).
   The damping keeps rare words from outweighing a text's many shared ones: one changed word of a copy makes shingles
   that no other document has.
3. Improved consistent weighted sampling draws `bands` x `rows` (shingle, level) samples whose chance of being equal is
   the weighted Jaccard similarity. Equal bands make candidates.
4. Equal texts are one node. In a bucket a node is compared with the bucket's least node and with the node before it in
   two orders, never with all; each pair is verified by the exact weighted Jaccard similarity of the whole texts. The
   orders are by the keys of other bands, so that nodes stand next to those that they share more bands with: a bucket of
   texts that share little more than one passage falls apart into its classes. A second round verifies all those
   candidates whose ends the first rounds left apart.
5. The texts of buckets that still hold more than one component are joined on their rarest shingles, each with the texts
   of other components. The join leaves out only pairs whose similarity is below the threshold by an exact bound, and
   all others are verified: whatever pair of a bucket has the similarity is in one class.
6. Connected components of verified links are the classes.

Shuffled are signatures and ids for all documents, and the texts of candidates only. Hot buckets are joins that Spark can
split, or aggregates with partial sums; nothing is gathered per bucket.

Words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Defined results: texts of under five
words are one shingle; texts without words are alike only where equal; null equals empty; repeated rows are copies; null
ids keep their row and never name a class that has an id; ties go to the least id; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import digest, text_or_empty
from tidemark.llm.kernels import NOT_ALNUM, grams, mix, slices, whole, words
from tidemark.operators.graph import merged_components
from tidemark.shared import Scratch, stored

BUCKETS, SHINGLE, DAMPING, DRAWS = 1 << 20, 5, 0.2, 1 << 16
SLACK = 1 - 1e-5  # weights of the same shingle differ by rounding


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per bucket of word hashes, and documents. 2^20 numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), NOT_ALNUM, lower=True)
                pairs = np.unique(w.doc * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64))
                found += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
                n += part.num_rows
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(found[some], n))], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    table = np.zeros(BUCKETS, np.int64)
    table[bucket[bucket >= 0]] = n[bucket >= 0]
    return table, int(n[bucket < 0].sum())


def idf_table(table: np.ndarray, n: int) -> np.ndarray:
    """IDF from 0 (in every document) to 1 (in none)."""
    return (np.log((1 + n) / (1 + table)) / np.log(2 + n)).astype(np.float32)


def weighted_shingles(texts: pa.Array, idf: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted by both, each shingle once per document."""
    w = words(texts, NOT_ALNUM, lower=True)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    g = grams(w, k)
    rare = np.append(0.0, np.cumsum(idf[(w.hash % np.uint64(len(idf))).astype(np.int64)], dtype=np.float64))
    at = np.arange(n)
    mean = (rare[np.minimum(at + k, n)] - rare[at]) / k
    fit = whole(w, k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    first, size = w.first[short], w.counts[short]
    acc = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
    for j in range(k - 1):
        ok = j < size
        acc[ok] = mix(acc[ok] * np.uint64(31) + w.hash[first[ok] + j])
    g[first], fit[first] = acc, True
    mean[first] = (rare[first + size] - rare[first]) / np.maximum(size, 1)
    doc, g, mean = w.doc[fit], g[fit], mean[fit]
    order = np.lexsort((g, doc))
    doc, g, mean = doc[order], g[order], mean[order]
    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (g[1:] != g[:-1])))
    times = np.diff(np.append(new, len(g)))
    return doc[new], g[new], (times * (1 + DAMPING * mean[new])).astype(np.float32)


@lru_cache(maxsize=2)
def _draws(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of consistent weighted sampling for 2^16 places per sample, and the samples' hash multipliers."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2, 1, (samples, DRAWS)).astype(np.float32)
    c = np.log(rng.gamma(2, 1, (samples, DRAWS))).astype(np.float32)
    return np.maximum(r, 1e-6), c, rng.random((samples, DRAWS), dtype=np.float32), rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their band keys)."""
    begin = np.flatnonzero(np.append(True, np.diff(doc) != 0))
    size = np.diff(np.append(begin, len(doc)))
    r_all, c_all, b_all, odd = _draws(bands * rows, seed)
    log_w = np.log(weight)
    keys = np.zeros((len(begin), bands), np.uint64)
    for s in range(bands * rows):
        at = ((shingle * odd[s]) >> np.uint64(48)).astype(np.int64)
        r, beta = r_all[s][at], b_all[s][at]
        t = np.floor(log_w / r + beta)
        a = c_all[s][at] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, begin)
        at = np.flatnonzero(a == np.repeat(least, size))
        at = at[np.append(True, np.diff(doc[at]) != 0)]  # of equal ones the least shingle
        one = mix(shingle[at] ^ mix(t[at].astype(np.int64).view(np.uint64)))
        keys[:, s // rows] = mix(keys[:, s // rows] * np.uint64(0x9E3779B97F4A7C15) + one + np.uint64(s // rows))
    return doc[begin], keys


def similarity(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    (d1, g1, w1), (d2, g2, w2) = weighted_shingles(left, idf), weighted_shingles(right, idf)
    doc, g = np.concatenate([d1, d2]), np.concatenate([g1, g2])
    w = np.concatenate([w1, w2]).astype(np.float64)
    order = np.lexsort((g, doc))
    doc, g, w = doc[order], g[order], w[order]
    both = np.flatnonzero((np.diff(doc) == 0) & (g[1:] == g[:-1])) if len(g) else np.zeros(0, np.int64)
    shared = np.bincount(doc[both], np.minimum(w[both], w[both + 1]), n)
    total = np.bincount(doc, w, n)
    return np.where(total > shared, shared / np.maximum(total - shared, 1e-300), 0.0)


def shingle_counts(texts: DataFrame, idf) -> np.ndarray:
    """Texts per bucket of shingle hashes. 2^20 numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found += np.bincount((weighted_shingles(part.column("text"), idf.value)[1] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS, np.int64)
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table


def prefixes(texts: pa.Array, idf: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight from it on, weight of the document) of each document's rarest shingles: without them too
    little weight is left for a similarity of `threshold` with any text."""
    doc, g, w = weighted_shingles(texts, idf)
    order = np.lexsort((g, counts[(g % np.uint64(len(counts))).astype(np.int64)], doc))
    doc, g, w = doc[order], g[order], w[order].astype(np.float64)
    n = len(texts)
    total = np.bincount(doc, w, n)
    size = np.bincount(doc, minlength=n)
    before = np.append(0.0, np.cumsum(w))
    end = np.cumsum(size)
    rest = before[end[doc]] - before[:-1]
    keep = rest >= threshold * total[doc] * SLACK
    return doc[keep], g[keep], rest[keep], total[doc[keep]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 14, rows: int = 3, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, digest (of its text), class_id (least id of its class), class_size, kept (true for
    the one text that stands for the class: that of the least id)."""
    spark = docs.sparkSession
    room = Scratch(spark, "minhash")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("node", digest("text"))
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(docs, text_col)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, shingle, weight = weighted_shingles(part.column("text"), idf.value)
                out = [None] * part.num_rows
                if len(doc):
                    for d, k in zip(*signatures(doc, shingle, weight, bands, rows, seed)):
                        out[d] = k.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    signed = texts.mapInArrow(sign, f"doc_id {id_type}, node binary, bands array<long>")
    # Equal texts meet here, as partial aggregates: a group of copies is one row.
    nodes = room.stored(signed.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "nodes")

    def of(i: Column) -> Column:
        near, far = (F.array(*[F.get("bands", (i + step) % bands) for step in steps]) for steps in ((1, 2, 3), (bands // 2, bands // 2 + 1, bands // 2 + 2)))
        return F.struct(i.alias("band"), F.get("bands", i).alias("key"), near.alias("near"), far.alias("far"))

    banded = nodes.where("bands is not null").select("node", F.inline(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), of)))
    centres = banded.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", "centre")
    met = banded.join(centres, ["band", "key"])
    bucket = Window.partitionBy("band", "key")
    beside = F.array("centre", *[F.lag("node").over(bucket.orderBy(order, "node")) for order in ("near", "far")])
    pairs = met.select("node", beside.alias("beside")).select("node", F.explode("beside").alias("other")).where("node <> other")
    pairs, n_pairs = room.counted(pairs.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct(), "pairs")
    if not n_pairs:
        apart = None
    else:
        wanted = pairs.select("node").union(pairs.select(F.col("other").alias("node"))).distinct().join(nodes.select("node", "least_id"), "node")
        wanted = wanted.select(F.col("node").alias("w"), "least_id")
        found = texts.join(wanted, (texts["node"] == wanted["w"]) & texts["doc_id"].eqNullSafe(wanted["least_id"]), "left_semi")
        found = room.stored(found.dropDuplicates(["node"]).select("node", "text"), "texts")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    s = similarity(part.column("text"), part.column("other_text"), idf.value)
                    ok = pa.array(s >= threshold)
                    yield pa.RecordBatch.from_arrays([part.column("node").filter(ok), part.column("other").filter(ok), pa.array(s).filter(ok)], names=["src", "dst", "similarity"])

        def links(some: DataFrame) -> tuple[DataFrame, int]:
            other = found.select(F.col("node").alias("other"), F.col("text").alias("other_text"))
            return room.counted(some.join(found, "node").join(other, "other").mapInArrow(verify, "src binary, dst binary, similarity double"), "links")

        def settle(first: DataFrame, untested: DataFrame, apart: DataFrame | None) -> DataFrame:
            """Components after testing the first pairs, then those untested ones whose ends are still apart."""
            more, n = links(first)
            if n:
                apart = merged_components(apart, more)
            if apart is None:
                apart = spark.createDataFrame([], "node binary, component binary")
            left, right = apart.select("node", F.col("component").alias("c1")), apart.select(F.col("node").alias("other"), F.col("component").alias("c2"))
            rest = untested.join(first, ["node", "other"], "left_anti").join(left, "node", "left").join(right, "other", "left").where(F.coalesce("c1", "node") != F.coalesce("c2", "other"))
            rest, n = room.counted(rest.select("node", "other"), "tests")
            more, n = links(rest) if n else (None, 0)
            return merged_components(apart, more) if n else apart

        apart = settle(pairs.groupBy("node").agg(F.min("other").alias("other")), pairs, None)

        # In a bucket of two its only pair is tested. In others, pairs of different components may not be.
        component = F.coalesce("component", "node").alias("component")
        placed = banded.select("band", "key", "node").join(centres.where("n > 2").select("band", "key"), ["band", "key"]).join(apart, "node", "left").select("band", "key", "node", component)
        placed = room.stored(placed, "placed")
        mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
        open_, n = room.counted(placed.join(mixed, ["band", "key"]).select("node", "component").distinct(), "open")
        if n:
            loose = open_.join(found, "node")
            rarity = spark.sparkContext.broadcast(shingle_counts(loose, idf))

            def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in slices(batch, "text"):
                        doc, g, rest, total = prefixes(part.column("text"), idf.value, rarity.value, threshold)
                        which = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([part.column("node").take(which), part.column("component").take(which), pa.array(g.view(np.int64)), pa.array(rest), pa.array(total)], names=["node", "component", "g", "rest", "total"])

            heads_ = room.stored(loose.select("node", "component", "text").mapInArrow(head, "node binary, component binary, g long, rest double, total double"), "heads")
            shared = heads_.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
            heads_ = room.stored(heads_.join(shared, "g"), "heads")
            # The lighter text of a pair has to share still rarer shingles.
            need = threshold / (1 + threshold) * SLACK
            light = heads_.where(F.col("rest") >= 2 * need * F.col("total"))
            left = light.select("g", F.col("component").alias("c1"), F.col("node").alias("n1"), F.col("rest").alias("r1"), F.col("total").alias("t1"))
            right = heads_.select("g", F.col("component").alias("c2"), F.col("node").alias("n2"), F.col("rest").alias("r2"), F.col("total").alias("t2"))
            fit = (F.col("c1") != F.col("c2")) & (F.struct("t1", "n1") < F.struct("t2", "n2")) & (F.least("r1", "r2") >= need * (F.col("t1") + F.col("t2")))
            met = left.join(right, "g").where(fit)
            # Of each text first up to three pairs for each component that it might join.
            ends = met.select(F.greatest("n1", "n2").alias("node"), F.least("n1", "n2").alias("other"), F.when(F.col("n1") < F.col("n2"), F.col("c1")).otherwise(F.col("c2")).alias("c"))
            untested, n = room.counted(ends.distinct().join(pairs, ["node", "other"], "left_anti"), "pairs")
            if n:
                turn = F.row_number().over(Window.partitionBy("node", "c").orderBy("other"))
                first = untested.withColumn("turn", turn).where("turn <= 3").select("node", "other")
                apart = settle(room.stored(first, "tests"), untested.select("node", "other"), apart)

    if apart is None:
        classes = nodes.withColumn("root", F.col("node"))
    else:
        classes = nodes.join(apart, "node", "left").withColumn("root", F.coalesce("component", "node"))
    classes = stored(classes.select("node", "root", "least_id", "copies"), "classes")
    room.drop()
    heads = classes.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), F.col("node").alias("node"))).alias("head"), F.sum("copies").alias("class_size"))
    member = classes.join(heads, "root").select(F.col("node").alias("of"), F.col("head.id").alias("class_id"), "class_size", (F.col("head.node") == F.col("node")).alias("heads"))
    rows_ = texts.select("doc_id", "node")
    return rows_.join(member, rows_["node"] == member["of"]).select("doc_id", F.col("node").alias("digest"), "class_id", "class_size", (F.col("heads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))

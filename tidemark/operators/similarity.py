"""Cosine similarity of TF-IDF vectors, for pairs above a threshold.

Weights are counts times ln((1 + n) / (1 + documents with the term)) + 1, of unit length. Texts of equal vectors are one
class. Terms are taken from the rarest on. From a term on, two vectors' product is at most that of the lengths of what is
left of both. Products are added up as long as that is REACH of the threshold or more: what comes after them adds less than
REACH of the threshold, so only pairs that have the rest of it by then are worked out in full.

Vectors are stored once, in blocks. Each pair of blocks is a row of a Cartesian product, whose task adds up the products of
the two blocks' texts in its memory, strip by strip. So what is written grows with the texts, and memory with a block; only
work grows with the square of the texts, as terms are as rare as their share of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.scan import ranked
from tidemark.shared import stored

#: The share of the threshold down to which terms are looked at before a pair is worked out.
REACH = 0.9
#: Terms and texts of a block; a table of few terms is cut into up to SPREAD blocks of FEW terms, so that it is shared out.
TERMS, TEXTS, FEW, SPREAD = 1_500_000, 10_000, 100_000, 16
#: Sums of a strip and products added at once; by how much bounds are set lower than they are, as sums are rounded.
CELLS, PRODUCTS, SLACK = 2_000_000, 4_000_000, 1e-6


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Runs of two or more letters, digits and underscores in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def term_bags(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, terms): each text's terms in order with their counts, in an array of (term, tf). Texts without terms have none.
    A text is shuffled once, and its terms are counted where it is."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else texts are put together by their size, and terms spill
    rows = docs.select(key, text).where(F.col(key).isNotNull()).repartition(n, key)
    counts = rows.select(key, F.explode(tokens(F.col(text), stop_words)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))


def _left(lens: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each term of each vector the length of the vector from it on."""
    squares = w * w
    sums = np.cumsum(squares)
    ends = np.append(0.0, sums)[np.cumsum(lens)]
    return np.sqrt(np.maximum(np.repeat(ends, lens) - sums + squares, 0.0))


def _block(rows: pa.Table, reach: float) -> pa.Table:
    """One block of rows (block, key, rank, raw): its keys and, by text and from the rarest on, terms and weights; and the
    places of those that are looked at first, by term and from the longest rest on. Keys without a row that has no raw are no
    class's, and go. Terms without a rank stand in no other text, and count for the length alone."""
    key = rows["key"].combine_chunks().dictionary_encode()
    text, names, sign = key.indices.to_numpy(zero_copy_only=False), key.dictionary, rows["raw"].is_null().to_numpy()
    named = np.zeros(len(names), bool)
    named[text[sign]] = True
    kept = np.flatnonzero(~sign & named[text])
    text, n = (np.cumsum(named) - 1)[text[kept]], int(named.sum())
    raw, rank = rows["raw"].fill_null(0.0).to_numpy()[kept], rows["rank"].fill_null(-1).to_numpy()[kept]
    length = np.sqrt(np.bincount(text, raw * raw, n))
    order = np.lexsort((rank, text))
    order = order[rank[order] >= 0]
    text, ids, w = text[order], rank[order].astype(np.int32), raw[order] / length[text[order]]
    lens = np.bincount(text, minlength=n).astype(np.int32)
    left = _left(lens, w)
    first = np.flatnonzero(left >= reach - SLACK)
    first = first[np.lexsort((-left[first], ids[first]))].astype(np.int32)
    keys = names.filter(pa.array(named))
    arrays = {c: pa.array([x.tobytes()], pa.binary()) for c, x in (("lens", lens), ("ids", ids), ("w", w), ("first", first))}
    return pa.table({"block": rows["block"].slice(0, 1), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), **arrays})


def _opened(row: pa.RecordBatch, side: str) -> SimpleNamespace:
    get = lambda name, kind: np.frombuffer(row.column(f"{side}_{name}")[0].as_buffer(), kind)
    b = SimpleNamespace(block=row.column(f"{side}_block")[0].as_py(), keys=row.column(f"{side}_keys")[0].values, lens=get("lens", np.int32), ids=get("ids", np.int32), w=get("w", np.float64), first=get("first", np.int32))
    b.starts = np.append(0, np.cumsum(b.lens, dtype=np.int64))
    b.text = np.repeat(np.arange(len(b.lens)), b.lens)
    b.left = _left(b.lens, b.w)
    return b


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of the given starts and sizes, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _near(a: SimpleNamespace, b: SimpleNamespace, least: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strips of pairs of texts of two blocks, with what their rarest common terms add up to, where that may be enough."""
    if not len(a.first) or not len(b.first):
        return
    place = lambda ids, left: ids + (1.5 - left) / 2  # by term, then from the longest rest on
    theirs = place(b.ids[b.first], b.left[b.first])
    ids = a.ids[a.first]
    low, size = np.zeros(len(a.ids), np.int64), np.zeros(len(a.ids), np.int64)
    low[a.first] = np.searchsorted(theirs, ids)
    size[a.first] = np.searchsorted(theirs, place(ids, (reach - SLACK) / a.left[a.first]), "right")
    size = np.maximum(size - low, 0)
    met = np.flatnonzero(size)
    low, size, mine, weight = low[met], size[met], a.text[met], a.w[met]
    text, w, n = b.text[b.first], b.w[b.first], len(b.lens)
    step = max(1, CELLS // n)
    for start in range(0, len(a.lens), step):
        i, end = np.searchsorted(mine, (start, start + step))
        if i == end:
            continue
        upto = np.cumsum(size[i:end])
        sums = np.zeros(min(step, len(a.lens) - start) * n)
        while i < end:
            done = upto[i - end - 1] if i - end > -len(upto) else 0
            j = max(i + 1, end - len(upto) + int(np.searchsorted(upto, done + PRODUCTS, "right")))
            at = _spans(low[i:j], size[i:j])
            cells = np.repeat((mine[i:j] - start) * n, size[i:j]) + text[at]
            sums += np.bincount(cells, np.repeat(weight[i:j], size[i:j]) * w[at], len(sums))
            i = j
        found = np.flatnonzero(sums >= least - reach - SLACK)
        x, y = found // n + start, found % n
        keep = slice(None) if a.block != b.block else x < y
        yield x[keep], y[keep], sums[found][keep]


def _meet(rows: Iterator[pa.RecordBatch], least: float, reach: float, n_terms: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Similar pairs of the texts of two blocks. A batch is one row, which holds both."""
    a, weights = None, np.zeros(n_terms + 1)
    for row in rows:
        if not row.num_rows:
            continue
        a = a if a is not None and a.block == row.column("x_block")[0].as_py() else _opened(row, "x")
        b = _opened(row, "y")
        for x, y, sofar in _near(a, b, least, reach):
            whole = np.zeros(len(x))
            bounds = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else ()
            for i, j in zip(bounds, bounds[1:]):
                own = slice(a.starts[x[i]], a.starts[x[i] + 1])
                weights[a.ids[own]] = a.w[own]
                size = b.lens[y[i:j]].astype(np.int64)
                at = _spans(b.starts[y[i:j]], size)
                whole[i:j] = np.add.reduceat(weights[b.ids[at]] * b.w[at], np.cumsum(size) - size)
                weights[a.ids[own]] = 0.0
            keep = np.flatnonzero(whole >= least)
            if len(keep):
                yield pa.RecordBatch.from_arrays([a.keys.take(pa.array(x[keep])), b.keys.take(pa.array(y[keep])), pa.array(sofar[keep]), pa.array(whole[keep])], schema=schema)


def similar_texts(docs: DataFrame, key: str, text: str, least: float, stop_words: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of classes whose vectors have a cosine of `least` or more, a < b, each named by its least key; and
    (key, class_id) of every text that has terms. Null texts have none; repeated rows of one key count once each."""
    spark, reach = docs.sparkSession, least * REACH
    bags = stored(term_bags(docs, key, text, stop_words), "bags")
    said = F.concat_ws(" ", F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string"))))
    named = stored(bags.select(key, F.unhex(F.sha2(said.cast("binary"), 256)).alias("bag")), "named")
    heads = named.groupBy("bag").agg(F.min(key).alias("class_id")).hint("merge")
    classes = stored(named.join(heads, "bag").select(key, "class_id"), "classes")
    n = docs.agg(F.countDistinct(key).alias("n")).first()["n"]
    seen = bags.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranks = stored(ranked(seen, [F.col("df"), F.col("term")], label="terms"), "ranks")
    total = ranks.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("held")).first()
    own = classes.where(F.col(key) == F.col("class_id")).select(key)
    n_blocks = max(1, -(-total["held"] // TERMS), -(-own.count() // TEXTS), min(SPREAD, -(-total["held"] // FEW)))
    # Terms are many and their files small, so Spark would broadcast them through the driver.
    rows = bags.select(F.col(key).alias("key"), F.inline("terms")).join(ranks.hint("merge"), "term", "left").withColumn("raw", F.col("tf") * (F.log((1 + F.lit(float(n))) / (1 + F.coalesce("df", F.lit(1)))) + 1))
    # A row without raw for each class: whole texts needn't be joined to tell which stand for one.
    rows = rows.select("key", F.col("rank").cast("int").alias("rank"), "raw").unionByName(own.withColumnRenamed(key, "key"), allowMissingColumns=True)
    rows = rows.select(F.pmod(F.hash("key"), F.lit(n_blocks)).alias("block"), "key", "rank", "raw")
    kind = docs.schema[key].dataType
    shape = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("lens", "ids", "w", "first")]])
    blocks = stored(rows.repartition(n_blocks, "block").groupBy("block").applyInArrow(lambda rows: _block(rows, reach), shape), "blocks")
    x, y = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "xy")
    # Each two blocks once, half of them either way round, so that the tasks have as many.
    even = (F.col("x_block") + F.col("y_block")) % 2 == 0
    both = x.join(y.hint("shuffle_replicate_nl"), (even & (F.col("x_block") <= F.col("y_block"))) | (~even & (F.col("x_block") > F.col("y_block"))))
    out = T.StructType([T.StructField("one", kind), T.StructField("two", kind), T.StructField("sofar", T.DoubleType()), T.StructField("similarity", T.DoubleType())])
    found = both.mapInArrow(partial(_meet, least=least, reach=reach, n_terms=total["terms"], schema=to_arrow_schema(out)), out)
    found = found.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "sofar", "similarity")
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1")  # a row is two blocks
    try:
        pairs = stored(found, "pairs")
    finally:
        conf.set(name, before)
    return pairs.select("a", "b", "similarity"), classes

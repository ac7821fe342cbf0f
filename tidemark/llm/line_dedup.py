"""Line dedup with compressed per-document keep bitmaps, in DataFrame functions only.

Each line becomes a hash of its key (stripped, A-Z lower-cased) with its document and position. The hashes are
range-partitioned by (salt, hash) and sorted within partitions by hash, document and position, so that in one stream over
a partition the first occurrence in each document, and in each salted part of a hash, stands first. The salt, drawn from
the document, splits a line that is in very many documents, here and in the join that tells its places. Hashes are
uniform, so ranges of equal width need no sampling. Parts meet as one row each: documents per key, and the very first
occurrence. What comes back for a document is its keep bitmap as runs of kept lines. A text is shuffled once, to meet its
bitmap, and cut by those runs.

Defined results: null or empty text is one empty line; keys shorter than `min_chars` are never dropped; repeated rows
(same id and text) count as one document and each gets its row; other columns are kept; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, ascii_lower, row_key, text_or_empty
from tidemark.shared import stored


def line_key(line: F.Column) -> F.Column:
    # The plain functions are many times faster than btrim and translate, which the few lines that need them get.
    edged = F.lit(False)
    for c in SPACES:
        edged = edged | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    line = F.when(edged, F.btrim(line, F.lit(SPACES))).otherwise(line)
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(ascii_lower(line))


def drop_positions(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, keep_first: bool, salts: int, partitions: int | None = None) -> DataFrame:
    """(dk, dropped): positions, from 0 and ascending, of the lines that each document loses."""
    lines = docs.select(row_key(id_col, text_col).alias("dk"), F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("dk", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keyed = keyed.select("dk", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"), F.pmod(F.xxhash64("dk"), F.lit(salts)).alias("salt"))
    # md5 is uniform, so ranges of equal width of (salt, hash) need no sampling: they follow from the first four bytes.
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("double") / 2.0**32
    placed = keyed.withColumn("range", F.floor((F.col("salt") + within) / salts * n).cast("int")).repartitionById(n, "range")
    stream = Window.partitionBy("range", "h", "salt").orderBy("dk", "pos")
    before = F.lag("dk").over(stream)
    marked = stored(placed.select("h", "salt", "dk", "pos", F.when(before.eqNullSafe(F.col("dk")), 0).otherwise(1).alias("new_doc")), "lines")
    keys = marked.groupBy("h").agg(F.sum("new_doc").alias("n_docs"), F.min(F.struct("dk", "pos")).alias("first")).where(F.col("n_docs") >= min_docs)
    # A key has one row for each salt, so that the places of a hot line meet it in many tasks.
    keys = keys.select(F.col("h").alias("kh"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("ks"), "first")
    hit = marked.join(keys, (marked["h"] == keys["kh"]) & (marked["salt"] == keys["ks"]))
    if keep_first:
        hit = hit.where(~((F.col("first.dk") == F.col("dk")) & (F.col("first.pos") == F.col("pos"))))
    return hit.groupBy("dk").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(n_lines: F.Column, dropped: F.Column) -> F.Column:
    """The keep bitmap as runs: array of (start, length) of consecutive kept lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, salts: int = 16) -> DataFrame:
    """docs with n_lines, n_dropped and keep_bitmap. Lines whose key is in at least `min_docs` documents are dropped
    everywhere, or everywhere but in their first place (by document key, then position) with keep_first."""
    docs = docs.drop("n_lines", "n_dropped", "keep_bitmap")  # earlier results by these names give way
    dropped = drop_positions(docs, id_col, text_col, min_docs, min_chars, keep_first, salts)
    dropped = dropped.select(F.col("dk").alias("__of"), F.col("dropped").alias("__dropped"))
    joined = docs.withColumn("__key", row_key(id_col, text_col)).join(dropped, F.col("__key") == F.col("__of"), "left")
    lost = F.coalesce(F.col("__dropped"), F.array().cast("array<int>"))
    n = F.size(F.split(text_or_empty(text_col), "\n", -1))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], n.cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_dropped"), keep_runs(n, lost).alias("keep_bitmap"))


def kept_text(text_col: str = "text", bitmap: str = "keep_bitmap") -> F.Column:
    """The kept lines, joined by newlines."""
    lines = F.split(text_or_empty(text_col), "\n", -1)
    return F.array_join(F.flatten(F.transform(bitmap, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")

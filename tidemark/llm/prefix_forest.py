"""Nearest neighbours by a forest of hash prefixes.

Every vector has a string of twelve symbols in each of TREES trees. A symbol is the largest of sixteen coordinates, with
its sign, after a random rotation: vectors that are near share long beginnings. A tree is the sorted array of its strings;
it is kept in shards by the first bits, and shards of many rows are split by a hash of the vector. A query descends in each
shard by binary search: how many strings share how many of its first bits. Summed over all trees, these counts tell how far
to ascend: the longest prefix length, the same in all trees, at which the query has met enough candidates. Whatever stands
there under the query's prefixes is compared, all of it, in blocks; nothing is capped. Where the longest prefix of a shard
is not enough, the ascent goes on over the shards with a common beginning, up to the root.

How many candidates are enough is fitted on a bounded sample: SAMPLE queries are answered by comparing all vectors, and
the least number that finds AIM of their neighbours is taken, but `least` a tree at the least. All vectors are indexed.

Inner products decide, so vectors are hashed with one more coordinate that gives all the same length; queries have 0 there.
Equal vectors are indexed once, with their k + 1 smallest ids: no query can be given more of them.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
only vectors of equal length meet; rows of one id and vector count once and a query does not meet its own id; equal scores
go by smaller id; other columns are ignored; empty input, or a query without candidates, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import Scratch

TREES = 24
WIDTH, SYMBOLS = 16, 12
SYMBOL_BITS = 5
BITS = SYMBOLS * SYMBOL_BITS
SAMPLE, AIM = 128, 0.97


@lru_cache(maxsize=4)
def _rotations(dim: int) -> list[np.ndarray]:
    """For each tree, orthonormal directions for all its symbols (dim + 1, SYMBOLS * WIDTH)."""
    rng = np.random.default_rng(dim)
    wide = -(-(dim + 1) // WIDTH) * WIDTH
    out = []
    for _ in range(TREES):
        parts, got = [], 0
        while got < SYMBOLS * WIDTH:
            parts.append(np.linalg.qr(rng.standard_normal((wide, min(wide, SYMBOLS * WIDTH))))[0])
            got += parts[-1].shape[1]
        out.append(np.concatenate(parts, 1)[: dim + 1, : SYMBOLS * WIDTH])
    return out


def codes(x: np.ndarray, longest: float | None) -> np.ndarray:
    """(TREES, n): the strings of vectors, five bits a symbol. longest: the greatest length of all; None: x are queries."""
    n, dim = x.shape
    more = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0)) if longest is not None else np.zeros(n)
    full = np.concatenate([x, more[:, None]], 1)
    out = np.zeros((TREES, n), np.int64)
    for tree, directions in enumerate(_rotations(dim)):
        y = (full @ directions).reshape(n, SYMBOLS, WIDTH)
        axis = np.abs(y).argmax(2)
        positive = np.take_along_axis(y, axis[:, :, None], 2)[:, :, 0] > 0
        for j in range(SYMBOLS):
            out[tree] = (out[tree] << SYMBOL_BITS) | (axis[:, j] * 2 + positive[:, j])
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, most: int = 4096) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows whose vectors have one length."""
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for i in range(0, len(rows), most):
            yield int(dim), batch.take(pa.array(rows[i : i + most]))


def _entries(longest: float | None, first_bits: int, carried: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each vector and tree: dim, tree, shard, code, and the columns carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                for tree, code in enumerate(codes(_matrix(part.column("v"), dim), longest)):
                    n = part.num_rows
                    fixed = [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(code >> (BITS - first_bits)), pa.array(code)]
                    yield pa.RecordBatch.from_arrays([*fixed, *[part.column(c) for c in carried]], names=["dim", "tree", "shard", "code", *carried])

    return run


def _ranges(sorted_codes: np.ndarray, code: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted array the strings stand that share the first `level` bits of each code."""
    rest = np.asarray(BITS - level, np.int64)
    low = (code >> rest) << rest
    return np.searchsorted(sorted_codes, low, "left"), np.searchsorted(sorted_codes, low + (np.int64(1) << rest), "left")


def _descend(first_bits: int) -> Callable[[pa.Table], pa.Table]:
    """For each query of a shard, how many strings share exactly so many first bits: gid, level, n."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("probe").to_numpy()
        code, gid = table.column("code").to_numpy(), table.column("gid").to_numpy()[asks]
        array, code = np.sort(code[~asks]), code[asks]
        out, deeper = [], np.zeros(len(code), np.int64)
        for level in range(BITS, first_bits - 1, -1):
            low, high = _ranges(array, code, level)
            new = high - low - deeper
            some = np.flatnonzero(new)
            out.append((gid[some], np.full(len(some), level, np.int32), new[some]))
            deeper = high - low
        g, level, n = (np.concatenate(x) for x in zip(*out))
        return pa.table({"gid": g, "level": level, "n": n})

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed up from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best_pairs(x: np.ndarray, first: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the `most` rows of x with the largest inner products with each row of q; ties to smaller
    `first`. A matrix product picks rows, with room for its rounding; exact sums decide."""
    scores = x @ q.T
    if len(x) > most:
        room = 1e-12 * np.sqrt((x * x).sum(1).max() * (q * q).sum(1)) * x.shape[1]
        row, query = np.nonzero(scores >= np.partition(scores, len(x) - most, 0)[len(x) - most] - room)
    else:
        row, query = (i.ravel() for i in np.indices(scores.shape))
    exact = products(x[row], q[query])
    order = np.lexsort((first[row], -exact, query))
    row, query, exact = row[order], query[order], exact[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < most
    return query[keep], row[keep], exact[keep]


def _compare(most: int) -> Callable[[pa.Table], pa.Table]:
    """For each query of a shard, the best of the vectors under its prefix."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        asks = table.column("probe").to_numpy()
        code, gid = table.column("code").to_numpy(), table.column("gid").to_numpy()
        x, first = _matrix(table.column("v"), dim), table.column("first").to_numpy()
        rows = np.flatnonzero(~asks)
        rows = rows[np.argsort(code[rows], kind="stable")]
        probes = np.flatnonzero(asks)
        low, high = _ranges(code[rows], code[probes], table.column("stop").to_numpy()[probes])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        bounds, which = np.unique(low * (len(rows) + 1) + high, return_inverse=True)
        for i, (a, b) in enumerate(zip(bounds // (len(rows) + 1), bounds % (len(rows) + 1))):
            mine, here = probes[which == i], rows[a:b]
            for j in range(0, len(mine) if len(here) else 0, 256):
                query, row, score = best_pairs(x[here], first[here], x[mine[j : j + 256]], most)
                out.append((mine[j : j + 256][query], here[row], score))
        query, row, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"gid": gid[query], "of": gid[row], "score": score, "first": first[row], "ids": table.column("ids").take(pa.array(row))})

    return run


def _scan(q: np.ndarray, gids: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best rows of each batch for a bounded sample of queries of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                if dim == q.shape[1]:
                    query, row, score = best_pairs(_matrix(part.column("v"), dim), part.column("first").to_numpy(), q, most)
                    yield pa.RecordBatch.from_arrays([pa.array(gids[query]), pa.array(score), part.column("v").take(pa.array(row))], names=["gid", "score", "v"])

    return run


def enough(levels: dict[int, dict[int, int]], shared: dict[int, list[int]]) -> int:
    """The least number of candidates by which AIM of the sample's neighbours are found. levels: for each query, how many
    strings share exactly so many first bits with it; shared: for each of its neighbours, the most bits in any tree."""
    found = sum(map(len, shared.values()))
    most = max(sum(n.values()) for n in levels.values())
    wanted = 1
    while wanted < most:
        hits = 0
        for gid, near in shared.items():
            total, stop = 0, 0
            for level in sorted(levels[gid], reverse=True):
                total += levels[gid][level]
                if total >= wanted:
                    stop = level
                    break
            hits += sum(n >= stop for n in near)
        if hits >= AIM * found:
            break
        wanted = int(wanted * 1.1) + 1
    return wanted


def _fit(base: DataFrame, probes: DataFrame, levels: DataFrame, longest: float, k: int) -> int:
    sample = probes.orderBy(F.xxhash64("gid")).limit(SAMPLE).collect()
    if not sample:
        return 1
    per: dict[int, dict[int, int]] = {r["gid"]: {} for r in sample}
    for r in levels.where(F.col("gid").isin(list(per))).collect():
        per[r["gid"]][r["level"]] = r["n"]
    shared: dict[int, list[int]] = {}
    for dim in {len(r["v"]) for r in sample}:
        rows = [r for r in sample if len(r["v"]) == dim]
        q, gids = np.array([r["v"] for r in rows], np.float64), np.array([r["gid"] for r in rows])
        kind = base.schema["v"].dataType.simpleString()
        best = Window.partitionBy("gid").orderBy(F.desc("score"))
        # One more, as the query is among the vectors.
        truth = base.mapInArrow(_scan(q, gids, k + 1), f"gid long, score double, v {kind}").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).collect()
        if truth:
            own = dict(zip(gids.tolist(), zip(codes(q, None).T, q.tolist())))
            for r, theirs in zip(truth, codes(np.array([r["v"] for r in truth], np.float64), longest).T):
                mine, vector = own[r["gid"]]
                if r["v"] != vector:
                    shared.setdefault(r["gid"], []).append(BITS - int((mine ^ theirs).min()).bit_length())
    return enough({g: per[g] for g in shared}, shared) if shared else 1


def _valid(v: Column) -> Column:
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = 2048, least: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every vector that `asked` marks. shard: about so many rows
    are in a shard; least: so many candidates a tree are looked at in any case."""
    room = Scratch(vectors.sparkSession, "forest")
    v, most = F.col(f"`{vector_col}`"), k + 1
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), asked.alias("asked")).where(F.col("id").isNotNull()).where(_valid(F.col("v")))
    kind = rows.schema["v"].dataType.simpleString()
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    base = rows.select("id", "v").withColumn("place", place).where(F.col("place") <= most).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    base = room.stored(base.select(F.monotonically_increasing_id().alias("gid"), "v", F.col("ids").cast("array<bigint>").alias("ids"), F.col("ids")[0].cast("long").alias("first")), "vectors")
    queries = rows.where("asked").select(F.col("id").alias("query_id"), F.col("v").alias("qv")).distinct()
    queries = room.stored(queries.join(base, queries["qv"] == base["v"]).select("query_id", "gid"), "queries")
    probes = room.stored(base.join(queries.select("gid").distinct(), "gid", "left_semi"), "probes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    whole = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(norm), F.lit(0.0)).alias("longest")).first()
    bits = min(40, max(0, floor(log2(max(1, whole["n"]) / shard))))
    head = "dim int, tree int, shard long, code long"
    strings = base.mapInArrow(_entries(whole["longest"], bits, ["gid"]), f"{head}, gid long")
    asks = room.stored(probes.mapInArrow(_entries(None, bits, ["gid"]), f"{head}, gid long"), "asks")
    sizes = strings.groupBy("dim", "tree", "shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = room.stored(sizes.withColumn("parts", F.ceil(F.col("n") / (4 * shard)).cast("int")), "sizes")
    big = sizes.where("parts > 1").select("dim", "tree", "shard", "parts")
    key = ["dim", "tree", "shard", "part"]
    split = lambda df: df.join(big, key[:3], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("gid"), F.col("parts")), F.lit(0)).cast("int"))
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    # Descent: exact prefix lengths within shards, then those that go over shards, from the shards' sizes.
    own = asks.join(sizes, key[:3]).select("dim", "tree", "shard", each_part, "code", "gid", F.lit(True).alias("probe"))
    deep = split(strings).select(*key, "code", "gid", F.lit(False).alias("probe")).unionByName(own).groupBy(*key).applyInArrow(_descend(bits), "gid long, level int, n long")
    level = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")
    above = sizes.select("dim", "tree", level, "shard", "parts", "n").withColumn("prefix", F.expr(f"shiftright(shard, {bits} - level)"))
    common = above.groupBy("dim", "tree", "level", "prefix").agg(F.sum("n").alias("n"))
    met = asks.select("dim", "tree", "gid", level, "shard").withColumn("prefix", F.expr(f"shiftright(shard, {bits} - level)")).join(common, ["dim", "tree", "level", "prefix"])
    wide = met.select("gid", F.explode(F.array(F.struct("level", "n"), F.struct((F.col("level") - 1).alias("level"), (-F.col("n")).alias("n")))).alias("x")).select("gid", "x.*").where(f"level between 0 and {bits - 1}")
    levels = room.stored(deep.unionByName(wide).groupBy("gid", "level").agg(F.sum("n").alias("n")), "levels")
    wanted = max(_fit(base, probes, levels, whole["longest"], k), least * TREES)
    # Ascent: the same prefix length in all trees.
    ahead = F.sum("n").over(Window.partitionBy("gid").orderBy(F.desc("level")))
    stops = levels.withColumn("total", ahead).groupBy("gid").agg(F.coalesce(F.max(F.when(F.col("total") >= wanted, F.col("level"))), F.lit(0)).alias("stop"))
    asking = asks.join(stops, "gid").withColumn("level", F.least("stop", F.lit(bits))).withColumn("prefix", F.expr(f"shiftright(shard, {bits} - level)")).drop("shard")
    routed = asking.join(above.drop("n"), ["dim", "tree", "level", "prefix"]).select("dim", "tree", "shard", each_part, "code", "gid", "stop")
    routed = routed.join(probes, "gid").select(*key, "code", "gid", F.lit(True).alias("probe"), "stop", "v", "first", "ids")
    fat = split(base.mapInArrow(_entries(whole["longest"], bits, ["gid", "v", "first", "ids"]), f"{head}, gid long, v {kind}, first long, ids array<bigint>"))
    fat = fat.select(*key, "code", "gid", F.lit(False).alias("probe"), F.lit(0).alias("stop"), "v", "first", "ids")
    found = fat.unionByName(routed).groupBy(*key).applyInArrow(_compare(most), "gid long, of long, score double, first long, ids array<bigint>")
    pairs = found.groupBy("gid", "of").agg(F.first("score").alias("score"), F.first("first").alias("first"), F.first("ids").alias("ids"))
    order = Window.partitionBy("gid").orderBy(F.desc("score"), "first")
    top = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    near = top.select("gid", F.explode("ids").alias("vec_id"), "score").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    answers = queries.join(near, "gid").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))

"""Approximate nearest neighbours by shifted space-filling curves.

Each of several orderings projects the vectors onto a few random directions, shifts the result and takes the position on
a Hilbert curve as key. Spark range-partitions every ordering by key, without the vectors; a query is compared with the rows around its own
position in any ordering, and the nearest are ranked by the exact distance. For that the vectors travel once, with their positions in all
orderings, and once more for every `QUERIES` queries. The window grows with the row count to the power 0.65 (a
fixed window would lose recall on larger tables, a fixed share would cost the square), or further: the nearest of at most
`MEASURED` rows are found by brute force in blocks, and the window is the one that holds enough of them.

The index is fitted on at most `sample` vectors, chosen by hash, for scales only; every row is indexed. Equal vectors
are indexed once with their smallest ids, so ties and a hot vector are exact.
Vectors that are null, zero, hold null or non-finite parts, or have another length than most take no part, neither as query nor as
candidate. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from depotflow.llm.common import reach_package, stage
from depotflow.operators.positions import with_position

ORDERINGS, DIRECTIONS, BITS, SEED = 24, 6, 8, 20_240
WINDOW, POWER, LEAST = 1.8, 0.65, 64
SAMPLE = 10_000
# The windows are widened until so large a share of the k nearest of some rows, found by brute force, lies inside them.
RECALL, MEASURED = 0.95, 200
MAP_ROWS = 500  # rows that are turned into keys at a time
# About so many rows are compared with so many queries in one group, a few queries at a time.
ROWS, QUERIES, AT_ONCE = 16_384, 8_192, 64
# What the expanded square of a distance may be off by, as a part of the squares in it; far more than doubles make it.
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates in [0, 2**bits); dimensions * bits <= 62.

    The known construction: undo the rotations from the highest bit down, then Gray-decode across the dimensions.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(lists: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Lists of one length, none of them null, as the rows of a matrix."""
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _window_for(indexed: DataFrame, k: int) -> int:
    """The half window that holds RECALL of the k nearest classes of at most MEASURED classes, in the ordering that is best for each."""
    some = indexed.select("rep", "v").orderBy(F.xxhash64("rep", F.lit(1))).limit(MEASURED).toArrow()  # at most MEASURED rows
    if len(some) < 2:
        return 0
    asked, x = some["rep"].to_numpy(), _matrix(some["v"], float)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, y = batch.column(0).to_numpy(), _matrix(batch.column(1), float)
            d = np.square(x).sum(1)[:, None] - 2 * x @ y.T + np.square(y).sum(1)
            d[asked[:, None] == reps] = np.inf
            least = np.partition(d, min(k, len(reps)) - 1, axis=1)[:, min(k, len(reps)) - 1] if len(reps) else np.zeros(len(d))
            at, best = np.nonzero((d <= least[:, None]) & np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(reps[best]), pa.array(d[at, best])], ["asker", "rep", "d"])

    near = indexed.select("rep", "v").mapInArrow(brute, "asker long, rep long, d double")
    order = F.row_number().over(Window.partitionBy("asker").orderBy("d", "rep"))
    near = stage(near.withColumn("at", order).filter(F.col("at") <= k).select("asker", "rep"))
    places = indexed.select("rep", "places")
    pairs = near.join(places, "rep").join(places.toDF("asker", "own"), "asker")
    gaps = F.array_min(F.zip_with("places", "own", lambda a, b: F.abs(a - b)))
    found = pairs.select(gaps.alias("gap")).toArrow()["gap"].to_numpy()  # at most k * MEASURED
    return int(np.ceil(np.quantile(found, RECALL))) if len(found) else 0


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    orderings: int = ORDERINGS, directions: int = DIRECTIONS, bits: int = BITS, window: float = WINDOW, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score: Euclidean distance) of the k nearest found for every row that `is_query`, an
    expression on the id column; ties go to the smaller id. Null ids take no part; rows of one id count as one candidate each.
    """
    reach_package(vectors.sparkSession)
    rows = vectors.filter(is_query.isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"), is_query.alias("q")
    )
    rows = rows.filter(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths["d"] if lengths else 1
    # the hash goes before the vector in every key, as sorting by vectors is slow
    rows = rows.filter(F.size("v") == dims).withColumn("h", F.xxhash64("v"))
    # one row for each different vector, with its k + 1 smallest ids (one of them may be the query's own)
    order = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    first = rows.withColumn("at", order).filter(F.col("at") <= k + 1).groupBy("h", "v").agg(F.collect_list("vec_id").alias("ids"))
    asked = rows.filter("q").select("h", "v", "q").distinct()
    joined = first.join(asked, ["h", "v"], "left")
    classes = stage(joined.select(F.array_min("ids").alias("rep"), "h", "v", "ids", F.coalesce("q", F.lit(False)).alias("q")))
    n = classes.count()
    rng = np.random.default_rng(SEED)
    axes = rng.normal(size=(orderings, dims, directions))
    shifts = rng.uniform(-0.5, 0.5, size=(orderings, directions))
    some = classes.select("v").orderBy(F.xxhash64("rep")).limit(sample).toPandas()["v"]  # at most `sample` vectors
    fitted = np.stack(some.to_list()).astype(float) if n else np.zeros((1, dims))
    centre = fitted.mean(0)
    scale = np.einsum("nd,tdp->tnp", fitted - centre, axes).std(axis=1) + 1e-12

    flat = axes.transpose(1, 0, 2).reshape(dims, -1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), MAP_ROWS):
                part = batch.slice(s, MAP_ROWS)
                x = (_matrix(part.column(1), float) - centre) @ flat
                unit = (x.reshape(-1, orderings, directions) / scale + shifts) / 7 + 0.5  # three and a half deviations each way
                cells = np.clip(unit * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                found = hilbert_keys(cells.reshape(-1, directions), bits)
                ends = np.arange(0, len(found) + 1, orderings, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, found)], ["rep", "keys"])

    keyed = stage(classes.select("rep", "v").mapInArrow(keys, "rep long, keys array<long>"))
    placed = with_position(keyed.select("rep", F.posexplode("keys").alias("t", "key")), ["t", "key", "rep"])
    r = F.col("position") % max(n, 1)
    places = F.array(*[F.max(F.when(F.col("t") == t, r)) for t in range(orderings)])
    # dealt by rep before, as rows of one rep rarely meet in a task and summing up there only widens them
    spots = placed.select("rep", "t", "position").repartition("rep").groupBy("rep").agg(places.alias("places"))
    indexed = stage(classes.select("rep", "v", "q").join(spots, "rep"))
    half = max(LEAST, round(window * n**POWER / 2), _window_for(indexed, k))
    blocks, parts = -(-n // ROWS) or 1, -(-indexed.filter("q").count() // QUERIES) or 1
    block, part = F.pmod(F.xxhash64("rep"), F.lit(blocks)), F.pmod(F.xxhash64("rep"), F.lit(parts))
    each = lambda number: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))
    around = indexed.select(block.alias("block"), each(parts).alias("part"), "rep", "v", "places", F.lit(False).alias("asks"))
    asking = indexed.filter("q").select(each(blocks).alias("block"), part.alias("part"), "rep", "v", "places", F.lit(True).alias("asks"))

    def compare(group: pa.Table) -> pa.Table:
        ask, have = group.filter(group["asks"]), group.filter(pc.invert(group["asks"])).sort_by("rep")
        askers, reps, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ask) and len(have):
            x, rep, at = _matrix(have["v"], float), have["rep"].to_numpy(), _matrix(have["places"], np.int64).T
            v, asker, own = _matrix(ask["v"], float), ask["rep"].to_numpy(), _matrix(ask["places"], np.int64).T
            ways = np.argsort(at, axis=1)
            sorted_at = np.take_along_axis(at, ways, 1)
            first = [np.searchsorted(a, o - half) for a, o in zip(sorted_at, own)]
            last = [np.searchsorted(a, o + half, "right") for a, o in zip(sorted_at, own)]
            squares = np.square(x).sum(1)
            for s in range(0, len(ask), AT_ONCE):
                rough = squares - 2 * v[s : s + AT_ONCE] @ x.T  # the squared distance less a constant of each query
                for i in range(s, min(s + AT_ONCE, len(ask))):
                    inside = np.zeros(len(x), bool)
                    for way, a, b in zip(ways, first, last):
                        inside[way[a[i] : b[i]]] = True
                    near = np.flatnonzero(inside)
                    if len(near) > k + 1:  # one of them may be the query's own class
                        close = rough[i - s, near]
                        near = near[close <= np.partition(close, k)[k] + SLACK * (squares.max() + np.square(v[i]).sum())]
                    d = np.sqrt(np.square(x[near] - v[i]).sum(axis=1))
                    best = np.argsort(d, kind="stable")[: k + 1]
                    askers.append(np.full(len(best), asker[i]))
                    reps.append(rep[near[best]])
                    scores.append(d[best])
        return pa.table({"asker": np.concatenate(askers), "rep": np.concatenate(reps), "score": np.concatenate(scores)})

    # a group holds a block of the rows and a part of the queries
    found = asking.unionByName(around).groupBy("block", "part").applyInArrow(compare, "asker long, rep long, score double")
    ids = classes.select("rep", F.col("ids"))
    best = F.row_number().over(Window.partitionBy("asker").orderBy("score", "rep"))
    top = found.withColumn("at", best).filter(F.col("at") <= k + 1).drop("at").join(ids, "rep")
    queries = rows.filter("q").select("vec_id", "h", "v").join(classes.filter("q").select(F.col("rep").alias("asker"), "h", "v"), ["h", "v"])
    pairs = queries.select(F.col("vec_id").alias("query_id"), "asker").join(top, "asker")
    pairs = pairs.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Nearest neighbours by shifted space-filling curves.

Vectors (scaled to unit length) are projected on several groups of directions;
each group's coordinates, shifted by a seeded offset, are put in order along a
Hilbert curve. Each curve is cut at sample quantiles into ranges of keys; Spark partitions
vectors and queries by ranges, in the curves' order, and each task passes along its own. A
query goes to the ranges within a window around its own, on each curve, what these find
is merged, and the scores are exact. Within a cell of the curve vectors are in seeded order, so
that a cell that holds many (close but not equal) is cut into several ranges; a query goes to all of them.

How far the window must reach depends on the data: it is measured on a bounded
sample, as the reach that would have found ``WANTED`` of the true neighbours
there. Clustered vectors need narrow windows. Vectors without structure
need wide ones, up to the whole curve: no curve keeps near neighbours together in
64 even dimensions, and a found share of 0.9 comes before speed.

Vectors that are equal count once (with their smallest ids, as many as could be
among the nearest), so a vector that is very common is neither a hot key nor a
large group.

Edge cases: scores that are equal rank by the smaller vec_id, over all ranges; vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without a vec_id or with another number of components
than most of the sample; a query's own id is never among its neighbours; with
fewer candidates than ``k`` all are returned; rows that repeat an id and a vector
count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import cut

K, QUERY_MODULUS = 5, 50
CURVES, DIMS, ORDER_BITS, SEED = 3, 3, 8, 11
#: Rows that the directions, cuts and window are fitted on, and of these the queries of the measurement.
SAMPLE, PROBES, WANTED = 4096, 256, 0.985
#: Vectors of one range of keys, about; what one task holds at once. Queries pass by in blocks.
RANGE_ROWS, BLOCK = 2048, 128
#: Bits of a place's seeded part, under those of the curve's key.
SALT_BITS = 24


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.transform(column, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null").filter(fine)


def hilbert(points, bits: int):  # noqa: ANN001, ANN201
    """Places along the Hilbert curve of integer points (rows): the Gray-code transform of their transposed bits."""
    import numpy as np

    x = points.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            swap = (x[0] ^ x[i]) & low
            high = (x[i] & q) != 0
            x[0] ^= np.where(high, low, swap)
            x[i] ^= np.where(high, np.uint64(0), swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Directions, shifts, cuts and window, fitted on sample rows."""

    def __init__(self, sample, ranges: int, k: int = K) -> None:  # noqa: ANN001
        import numpy as np

        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.size, self.ranges = unit.shape[1], ranges
        r = np.random.default_rng(SEED)
        _, _, axes = np.linalg.svd(unit - unit.mean(0), full_matrices=False)
        need = CURVES * DIMS
        while len(axes) < need:  # few components: the same directions, turned
            axes = np.concatenate([axes, axes @ np.linalg.qr(r.normal(size=(self.size, self.size)))[0]])
        self.axes = axes[:need]
        along = unit @ self.axes.T
        self.low = along.min(0) - 1e-9
        self.span = np.maximum(along.max(0) - self.low, 1e-9) * 1.25
        self.shift = r.uniform(0, 0.2, need)
        keys = self.keys(sample)
        self.cuts = [np.quantile(c, np.arange(1, ranges) / ranges, method="nearest").astype(np.int64) for c in self.spread(keys, sample)]
        probes = np.arange(0, len(unit), max(1, len(unit) // PROBES))
        near = unit[probes] @ unit.T
        near[np.arange(len(probes)), probes] = -np.inf
        top = np.argsort(-near, axis=1)[:, : min(k, max(1, len(unit) - 1))]
        apart = np.full(top.shape, np.inf)
        for c in keys:  # from the ends of the probe's own cell, which is met whole
            order, rank = np.sort(c), np.argsort(np.argsort(c, kind="stable"), kind="stable")[top]
            first, last = (np.searchsorted(order, c[probes], side=side)[:, None] for side in ("left", "right"))
            apart = np.minimum(apart, np.maximum(0, np.maximum(first - rank, rank - last + 1)) / len(unit))
        self.window = float(np.quantile(apart, WANTED))

    def keys(self, vectors) -> list:  # noqa: ANN001
        import numpy as np

        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        scaled = np.clip((unit @ self.axes.T - self.low) / self.span + self.shift, 0, 1 - 1e-9)
        cells = (scaled * (1 << ORDER_BITS)).astype(np.int64)
        return [hilbert(cells[:, i * DIMS : (i + 1) * DIMS], ORDER_BITS) for i in range(CURVES)]

    def spread(self, keys: list, vectors) -> list:  # noqa: ANN001
        """Places: the keys, and among equal ones a seeded order of the vectors."""
        import numpy as np

        bits = np.ascontiguousarray(vectors, dtype=np.float64).view(np.uint64)
        mixed = np.zeros(len(bits), np.uint64)
        for column in bits.T:
            mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        salt = (mixed >> np.uint64(64 - SALT_BITS)).astype(np.int64)
        return [(key << SALT_BITS) | salt for key in keys]

    def places(self, vectors) -> list:  # noqa: ANN001
        """For each curve the range that each vector lies in."""
        import numpy as np

        return [np.searchsorted(c, place, side="right") for c, place in zip(self.cuts, self.spread(self.keys(vectors), vectors), strict=True)]

    def windows(self, vectors) -> list:  # noqa: ANN001
        """For each curve the first and last range that a query goes to: its cell's, and ``reach`` beyond."""
        import numpy as np

        reach, ends = self.reach(), []
        for c, key in zip(self.cuts, self.keys(vectors), strict=True):
            first, last = np.searchsorted(c, key << SALT_BITS, side="right"), np.searchsorted(c, ((key + 1) << SALT_BITS) - 1, side="right")
            ends.append((np.maximum(0, first - reach), np.minimum(self.ranges - 1, last + reach)))
        return ends

    def reach(self) -> int:
        """Ranges on either side of a query's own."""
        import math

        return min(self.ranges - 1, math.ceil(self.window * self.ranges))


MET = "place long, query_id long, ids array<long>, v array<double>"


def along_curves(distinct: DataFrame, queries: DataFrame, curves: Curves) -> DataFrame:
    """Vectors (ids, v) and queries (query_id, v) by ranges, one row for each that they belong or go to, partitioned and sorted by these."""
    import numpy as np

    ranges = curves.ranges

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for curve, at in enumerate(curves.places(np.stack(b["v"].to_numpy())) if len(b) else []):
                yield pd.DataFrame({"place": curve * ranges + at, "query_id": pd.array([None] * len(b), "Int64"), "ids": b["ids"], "v": b["v"]})

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for curve, (first, last) in enumerate(curves.windows(np.stack(b["v"].to_numpy())) if len(b) else []):
                for at in range(int(first.min()), int(last.max()) + 1):
                    some = (first <= at) & (at <= last)
                    if some.any():
                        yield pd.DataFrame({"place": curve * ranges + at, "query_id": b["query_id"][some], "ids": None, "v": b["v"][some]})

    met = distinct.select("ids", "v").mapInPandas(held, MET).unionByName(queries.mapInPandas(asked, MET))
    tasks = min(CURVES * ranges, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the cuts are at hand, so neighbouring ranges go to a task without another sample of the rows
    task = F.floor(F.col("place") * tasks / (CURVES * ranges)).cast("int")
    return met.repartitionById(tasks, task).sortWithinPartitions("place", F.col("query_id").asc_nulls_first())


def scanned(met: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the ``k`` nearest of each range for each query that goes there."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        place, ids, parts, v, norm = None, [], [], None, None
        for b in batches:
            edges = [0, *(np.flatnonzero(np.diff(b["place"])) + 1).tolist(), len(b)] if len(b) else []
            for start, end in zip(edges, edges[1:], strict=False):
                rows = b.iloc[start:end]
                if rows["place"].iloc[0] != place:
                    place, ids, parts, v = rows["place"].iloc[0], [], [], None
                asks = rows["query_id"].notna()
                if not asks.all():
                    own = rows[~asks]
                    ids += own["ids"].to_list()
                    parts.append(np.stack(own["v"].to_numpy()))
                if asks.any() and parts:
                    if v is None or len(parts) > 1:
                        parts = [np.concatenate(parts)]
                        v, norm = parts[0], np.sqrt((parts[0] * parts[0]).sum(1))
                    some = rows[asks]
                    for at in range(0, len(some), BLOCK):
                        yield nearest_of(some["query_id"].to_numpy()[at : at + BLOCK], np.stack(some["v"].to_numpy()[at : at + BLOCK]), ids, v, norm, k)

    return met.mapInPandas(scan, "query_id long, vec_id long, score double")


def nearest_of(queries, q, ids: list, v, norm, k: int) -> pd.DataFrame:  # noqa: ANN001
    """The ``k`` best rows of each query: all vectors as near as the (k+1)-th, but for rounding, are scored exactly."""
    import numpy as np

    near = q @ (v / norm[:, None]).T / np.sqrt((q * q).sum(1))[:, None]
    most = min(len(v), k + 1)  # one more than k, as the query's own may be among them
    least = -np.partition(-near, most - 1, axis=1)[:, most - 1 : most] - 1e-9
    out = []
    for query, a, one, bound in zip(queries.tolist(), q, near, least[:, 0], strict=True):
        rows = np.flatnonzero(one >= bound)
        scores = (a * v[rows]).sum(1) / (np.sqrt((a * a).sum()) * norm[rows])
        found = sorted((-s, i) for row, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[row] if i != query)
        out += [(query, i, -s) for s, i in found[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, k: int = K, modulus: int = QUERY_MODULUS, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id ``modulus`` divides."""
    import numpy as np

    spark = vectors.sparkSession
    part = usable(vectors, column)
    spread = F.xxhash64("vec_id", "v")
    sample = [r["v"] for r in part.orderBy(spread, "vec_id").limit(SAMPLE).collect()]
    result = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], result)
    sizes = [len(v) for v in sample]
    size = max(sorted(set(sizes)), key=sizes.count)
    part = part.filter(F.size("v") == size)
    # equal vectors once, with the smallest ids that could matter: k and the query's own
    first = Window.partitionBy("v").orderBy("vec_id")
    ids = part.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    distinct = cut(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    ranges = max(1, round(distinct.count() / RANGE_ROWS))
    curves = Curves(np.array([v for v in sample if len(v) == size]), ranges, k)
    queries = part.filter(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    found = scanned(along_curves(distinct, queries, curves), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

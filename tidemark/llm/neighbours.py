"""Nearest neighbours by collision counting: query-centred windows over sorted projections, widened until the nearest are sure enough.

Every vector is projected on ``PROJECTIONS`` random directions, and each direction's projections are sorted. A query opens a window around
its own projection in each sorted array; a vector collides where it is in the window. Vectors with enough collisions are verified by their
true distance. Windows widen by steps (virtual rehashing: the arrays stay, only their ends move) until they are as wide as the
k-th best distance so far asks for: what is nearer has then been met with the chance that the threshold was chosen for.

In Spark the query set meets all rows in blocks: query block t and row group g meet in cell (t, g), a partition of its own that holds the
query block and streams the group's rows in chunks. The k-th best distance goes on from chunk to chunk, so later windows are narrow. Both
blocks are bounded in bytes; queries travel once for each row group and rows once for each query block.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

NEAREST = 10
#: Random directions, half the width of a window for radius 1, and by how many standard deviations the threshold is below the expected collisions at that radius.
PROJECTIONS, HALF_WIDTH, SLACK = 64, 1.25, 2.0
#: First radius as a part of the best distance known, and by what factor it grows.
FIRST, GROWTH = 0.25, 1.5
SEED = 13
#: Bytes of the vectors of a query block and of a chunk; rows of a group at most; queries that a chunk counts for at once.
BLOCK_BYTES, CHUNK_BYTES, GROUP_ROWS, COUNTED = 1 << 26, 1 << 23, 1 << 19, 128
#: Cells take no fewer rows than this to keep all cores busy.
LEAST_ROWS = 4096
#: Rounding of projections as a part of the largest.
ROUNDING = 1e-9
_MARK = np.iinfo(np.int16).min


def threshold() -> int:
    """Fewest collisions of a candidate."""
    p = 2 * NormalDist().cdf(HALF_WIDTH) - 1
    return max(1, int(PROJECTIONS * (p - SLACK * (p * (1 - p) / PROJECTIONS) ** 0.5)))


def directions(dim: int) -> np.ndarray:
    """``PROJECTIONS`` directions; as many as there are dimensions are orthogonal, and a unit vector's projections have variance 1."""
    rng = np.random.default_rng([SEED, dim])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(parts, axis=1)[:, :PROJECTIONS] * dim**0.5


class Best:
    """The ``k`` nearest so far of each query, nearest first; ties go to the smaller id, rows without one last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.inf)
        self.rank = np.full((n, k, 2), np.iinfo(np.int64).max)  # whether there is no id, the id
        self.found = np.zeros(n, np.int64)

    def bound(self, some: slice) -> np.ndarray:
        """The k-th best distances; infinite where fewer are known."""
        return self.score[some, -1]

    def add(self, i: int, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        n = int(self.found[i])
        if n == self.k:
            near = score <= self.score[i, -1]
            score, none, ids = score[near], none[near], ids[near]
        s = np.concatenate([self.score[i, :n], score])
        r = np.concatenate([self.rank[i, :n], np.stack([none, ids], axis=1)])
        order = np.lexsort((r[:, 1], r[:, 0], s))[: self.k]
        self.found[i] = len(order)
        self.score[i, : len(order)], self.rank[i, : len(order)] = s[order], r[order]


class Rows:
    """Vectors of one dimension as a matrix, with their row numbers and ids."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        self.row, self.id, self.none = (t[c].to_numpy() for c in ("row", "id", "none"))
        self.vector = np.concatenate([c.flatten().to_numpy() for c in t["vector"].chunks]).reshape(len(self.row), -1)

    def __len__(self) -> int:
        return len(self.row)

    def projected(self, proj: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        return self.vector[some].astype(np.float64) @ proj


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    d = rows.astype(np.float64) - query.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def search(queries: Rows, chunk: Rows, best: Best, proj: np.ndarray) -> None:
    """Bring ``best`` up to date with a chunk of rows.

    The first rows are verified for queries that know fewer than k, so that there is a distance to start from. A radius grows up to the
    k-th best distance of its time; the search ends once it has been as wide as the k-th best is, or holds all rows.
    """
    n, need = len(chunk), threshold()
    values = chunk.projected(proj).T
    order = np.argsort(values, axis=1).astype(np.int32)
    ordered = np.take_along_axis(values, order, axis=1)
    widest, rounding = float(np.max(ordered[:, -1] - ordered[:, 0])), ROUNDING * float(np.abs(ordered).max())

    def judge(i: int, at: np.ndarray) -> None:
        at = at[chunk.row[at] != queries.row[i]]
        best.add(i, distances(chunk.vector[at], queries.vector[i]), chunk.none[at], chunk.id[at])

    for a in range(0, len(queries), COUNTED):
        b = min(a + COUNTED, len(queries))
        own = queries.projected(proj, slice(a, b)).T
        count = np.zeros((b - a, n), np.int16)
        for j in np.flatnonzero(best.found[a:b] < best.k):
            judge(a + j, np.arange(min(n, 4 * best.k)))
            count[j, : 4 * best.k] = _MARK
        low, high = np.zeros((2, PROJECTIONS, b - a), np.int64)
        bound = best.bound(slice(a, b))
        radius = np.where(np.isfinite(bound), FIRST * bound, np.inf)  # fewer than k rows so far: all are met
        active, first = np.arange(b - a), True
        while len(active):
            half = HALF_WIDTH * radius[active] + rounding
            ends = np.array([[np.searchsorted(o, x - half), np.searchsorted(o, x + half, "right")] for o, x in zip(ordered, own[:, active], strict=True)])
            for k, j in enumerate(active):
                left, right = ends[:, 0, k], ends[:, 1, k]
                spans = [(left, right)] if first else [(left, low[:, j]), (high[:, j], right)]
                met = np.concatenate([o[x:y] for xs, ys in spans for o, x, y in zip(order, xs, ys, strict=True)])
                count[j] += np.bincount(met, minlength=n).astype(np.int16)
                hits = np.flatnonzero(count[j] >= need)
                if len(hits):
                    count[j, hits] = _MARK  # verified once
                    judge(a + j, hits)
                low[:, j], high[:, j] = left, right
            bound = best.bound(slice(a, b))
            active = active[(radius[active] < bound[active]) & (half < widest)]
            radius = np.minimum(GROWTH * radius, bound)
            first = False


def _stream(k: int):
    """Per cell and dimension: the queries first, then rows in chunks."""

    def results(queries: Rows, best: Best) -> pa.RecordBatch:
        i, j = np.nonzero(np.arange(best.k)[None] < best.found[:, None])
        columns = [queries.row[i], queries.id[i], best.rank[i, j, 0], best.rank[i, j, 1], best.score[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "query_id", "none", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best, proj = None, None, None, None
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk_done() -> None:
            nonlocal held, size
            if held and best is not None:
                search(queries, Rows(held), best, proj)
            held, size = [], 0

        for batch in batches:
            marks = np.stack([batch["cell"].to_numpy(), batch["dim"].to_numpy(), batch["kind"].to_numpy()])
            starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                cell, dim, kind = marks[:, a].tolist()
                part = batch.slice(a, b - a)
                if (cell, dim, kind) != key:
                    if key and key[2] == 0 and (cell, dim) == key[:2]:  # all queries are there
                        queries, proj = Rows(held), directions(dim)
                        best = Best(len(queries), k)
                        held, size = [], 0
                    else:
                        if key and key[2] == 1:
                            chunk_done()
                        if best is not None:
                            yield results(queries, best)
                        held, size, best = [], 0, None
                    key = (cell, dim, kind)
                if kind == 1 and best is None:
                    continue  # no query has this dimension
                rows = max(1, CHUNK_BYTES // (8 * max(dim, PROJECTIONS)))
                while kind == 1 and size + part.num_rows >= rows:
                    held.append(part.slice(0, rows - size))
                    part = part.slice(rows - size)
                    chunk_done()
                if part.num_rows:
                    held.append(part)
                    size += part.num_rows
        if key and key[2] == 1:
            chunk_done()
        if best is not None:
            yield results(queries, best)

    return run


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, asked: Column, k: int = NEAREST, ident: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest rows of each row for which ``asked`` holds: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (Euclidean distance).

    Vectors that aren't ``usable`` take no part, nor do vectors of different lengths meet. A row is not its own neighbour; another row of its id is
    another candidate, and a repeated query gives its rows again. Ties go to the smaller id; candidates without an id come last among them, and
    rows without an id are no queries. With fewer candidates than ``k`` all are given; an empty table gives no rows. Other columns are not read.

    Of equal vectors only the k + 1 of the smallest ids can be among anyone's nearest, so no more of them are candidates: exact, whatever the size of the group.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "neighbours")
    part = vectors.where(usable(F.col(vector))).withColumn("_asked", F.coalesce(asked & F.col(ident).isNotNull(), F.lit(False)))
    rows = part.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(ident).cast("long"), F.lit(0)).alias("id"), F.col(ident).isNull().cast("long").alias("none"),
        F.size(vector).alias("dim"), F.col(vector).alias("vector"), "_asked",
    )
    rows = scratch.write(rows, "rows")  # row numbers are fixed by the table
    n, asking, dim = rows.agg(F.count(F.lit(1)), F.count_if("_asked"), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, -(-asking * dim * 8 // BLOCK_BYTES))
    groups = max(-(-n // GROUP_ROWS), min(2 * spark.sparkContext.defaultParallelism // blocks, n // LEAST_ROWS), 1)
    equal = F.row_number().over(_by("vector", "none", "id", "row"))
    candidates = rows.withColumn("_nth", equal).where(F.col("_nth") <= k + 1)
    spread = lambda df, own, others, of, kind: df.select(
        F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("_other"), F.pmod(F.xxhash64("row"), F.lit(own)).cast("int").alias("_own"), F.lit(kind).alias("kind"), "dim", "row", "id", "none", "vector",
    ).withColumn("cell", of(F.col("_own"), F.col("_other")))
    cells = spread(rows.where("_asked"), blocks, groups, lambda own, other: own * groups + other, 0).unionByName(spread(candidates, groups, blocks, lambda own, other: other * groups + own, 1))
    dealt = cells.drop("_own", "_other").repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "dim", "kind", "row")
    found = dealt.mapInArrow(_stream(k), "row long, query_id long, none long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(_by("row", "score", "none", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("none") == 0, F.col("id")).alias("vec_id"), "score")


def _by(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)

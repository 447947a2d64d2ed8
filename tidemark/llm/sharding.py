"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into P buckets. How many rows each bucket sends to each shard is drawn from the multivariate hypergeometric
distribution, which is the law these counts follow in a uniform shuffle with fixed shard sizes. Each bucket permutes its
rows and deals them out by its row of the matrix; each shard permutes what it receives. Bucket, permutations and matrix
depend on nothing but the seed and the rows, so a task that runs again on another executor does the same. Rows that are equal
in ``ids`` are told apart by a hash of all their columns; what still ties is equal in everything.

Shard sizes differ by one row at most. Work is split by bucket, and within a shard by sub-bucket: no task holds a shard. Rows that are equal in
everything and many (``HOT_ROWS``) travel as one row and their number, and are numbered when they are written out again, so they
are spread over buckets like others. The matrix is drawn from the top of a binary tree of buckets down, by shards times buckets draws
whatever the number of rows. It has at most ``MAX_BUCKETS`` rows; counts of buckets and sub-buckets are all that reaches the driver or is joined.

Defined results: a null text has no bytes; very long texts are rows like others; null ids are ids like others; repeated rows
are dealt out like others; an empty table gives no rows; other columns are carried along, but ``shard`` and ``slot`` are
replaced, and columns that begin with ``_sh_`` are the operator's own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 250_000
#: Equal rows from which on they are numbered, and how many are written out by one task.
HOT_ROWS = 10_000
#: Groups of equal rows that may be spread to all executors.
MAX_SPREAD = 100_000
#: Populations from which on numpy doesn't draw.
NUMPY_LIMIT = 10**9
#: Draws up to which they are made one by one, and means up to which a count is found by summing probabilities from the least on.
FEW, SMALL_MEAN = 32, 12.0


def _log_factorial_step(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log((a + d)! / a!) for whole numbers, without taking the difference of two large logarithms: Stirling's series where both are large."""
    a, d = np.asarray(a, float), np.asarray(d, float)
    b = a + d
    low = np.minimum(a, b) < 64
    x, y, e = np.where(low, 64.0, a), np.where(low, 64.0, b), np.where(low, 0.0, d)
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    out = (y + 0.5) * np.log1p(e / x) + e * (np.log(x) - 1) + tail(y) - tail(x)
    for i in np.flatnonzero(low):
        out.flat[i] = math.lgamma(b.flat[i] + 1) - math.lgamma(a.flat[i] + 1)
    return out


def hypergeometric(good: np.ndarray, bad: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of ``draws`` rows, drawn without replacement, are good: for populations of any size.

    numpy draws from small populations. From large ones few draws (or draws that leave few) are made one by one, a small mean is inverted from the least count
    on, and all else is drawn by rejection under a hat of the ratio-of-uniforms method (Stadlober), which takes a few tries whatever the numbers.
    """
    good, bad, draws = (np.atleast_1d(np.asarray(x, np.int64)).copy() for x in (good, bad, draws))
    out, total = np.zeros(len(good), np.int64), good + bad
    small = total < NUMPY_LIMIT
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    at = np.flatnonzero(~small)
    # By symmetry the draws, and the good, are at most half of all.
    n, k, whole = draws[at], good[at], total[at]
    turned, swapped = n > whole - n, k > whole - k
    n, k = np.where(turned, whole - n, n), np.where(swapped, whole - k, k)
    n, k = np.minimum(n, k), np.maximum(n, k)  # drawn and good are alike
    mean = n * (k / whole)
    x = np.zeros(len(at), np.int64)
    few = n <= FEW
    for i in range(FEW):
        on = few & (i < n)
        x[on] += rng.random(int(on.sum())) * (whole - i)[on] < (k - x)[on]
    least = ~few & (mean <= SMALL_MEAN)
    if least.any():
        x[least] = _from_zero(n[least], k[least], whole[least], rng)
    rest = np.flatnonzero(~few & ~least)
    x[rest] = _rejection(n[rest], k[rest], whole[rest], rng)
    got = np.where(swapped, np.minimum(draws[at], whole - draws[at]) - x, x)  # good among the smaller part
    out[at] = np.where(turned, good[at] - got, got)
    return out


def _from_zero(n: np.ndarray, k: np.ndarray, whole: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts up to which the probabilities add up to a uniform number."""
    rest = (whole - k - n).astype(float)  # not negative: both are at most half
    p = np.exp(_log_factorial_step(whole, -n) - _log_factorial_step(whole - k, -n))
    u, x = rng.random(len(n)), np.zeros(len(n), np.int64)
    on = u > p
    while on.any():
        u[on] -= p[on]
        p[on] *= (k - x)[on].astype(float) * (n - x)[on] / ((x + 1.0) * (rest + x + 1))[on]
        x[on] += 1
        on &= (u > p) & (x < n)
    return x


def _rejection(n: np.ndarray, k: np.ndarray, whole: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    share = k / whole
    mean = n * share
    deviation = np.sqrt(mean * (1 - share) * ((whole - n) / (whole - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * deviation + 3 - 2 * math.sqrt(3 / math.e)
    mode = np.floor((n + 1.0) * ((k + 1.0) / (whole + 2.0))).astype(np.int64)
    x, open_ = np.zeros(len(n), np.int64), np.arange(len(n))
    while len(open_):
        u, v = 1 - rng.random(len(open_)), rng.random(len(open_))
        y = np.floor(mean[open_] + 0.5 + width[open_] * (v - 0.5) / u)
        inside = (y >= 0) & (y <= n[open_])
        i, u, y = open_[inside], u[inside], y[inside].astype(np.int64)
        m, d = mode[i], y - mode[i]
        log_p = -_log_factorial_step(m, d) - _log_factorial_step(k[i] - m, -d) - _log_factorial_step(n[i] - m, -d) - _log_factorial_step(whole[i] - k[i] - n[i] + m, d)
        taken = 2 * np.log(u) <= log_p
        x[i[taken]] = y[taken]
        open_ = np.setdiff1d(open_, i[taken], assume_unique=True)
    return x


def draw_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts from each bucket to each shard: rows sum to the buckets' sizes, columns to shard sizes one apart at most.

    Halves of the buckets share out what their parent has of each shard, down to single buckets; draws of one depth are made together.
    """
    total, rng = int(rows.sum()), np.random.default_rng(seed)
    depth = max(0, int(len(rows) - 1).bit_length())
    sizes = [np.concatenate([rows, np.zeros((1 << depth) - len(rows), np.int64)]).astype(np.int64)]
    while len(sizes[-1]) > 1:
        sizes.append(sizes[-1].reshape(-1, 2).sum(axis=1))
    have = np.array([[total // shards + (j < total % shards) for j in range(shards)]], np.int64)
    for level in reversed(sizes[:-1]):
        need, rest = level[::2].copy(), have.sum(axis=1)
        left = np.zeros_like(have)
        for j in range(shards):
            rest -= have[:, j]
            left[:, j] = hypergeometric(have[:, j], rest, need, rng)
            need -= left[:, j]
        have = np.stack([left, have - left], axis=1).reshape(-1, shards)
    return have[: len(rows)]


def _spread_equal(df: DataFrame, ids: list[str | Column], seed: int, scratch: Scratch) -> DataFrame:
    """``df`` with ``_sh_e`` (a hash of all other columns) and ``_sh_i``: a number that tells apart rows that are equal in everything, where there are many."""
    rest = [F.col(c).cast("string") if "map<" in kind else F.col(c) for c, kind in df.dtypes if c not in [i for i in ids if isinstance(i, str)]]
    keyed = df.withColumns({"_sh_e": F.xxhash64(F.lit(seed), *rest, *[c.isNull() for c in rest]), "_sh_g": F.xxhash64(F.lit(seed), F.lit(0), *ids)})
    key = ["_sh_g", "_sh_e"]
    many = scratch.write(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_sh_n")).where(F.col("_sh_n") > HOT_ROWS), "equal")
    groups = many.count()
    if not groups:
        return keyed.drop("_sh_g").withColumn("_sh_i", F.lit(0).cast("long"))
    spread = F.broadcast(many) if groups <= MAX_SPREAD else many
    others = keyed.join(spread, key, "left_anti").drop("_sh_g").withColumn("_sh_i", F.lit(0).cast("long"))
    one = keyed.join(spread, key).groupBy(*key, "_sh_n").agg(F.any_value(F.struct(*df.columns)).alias("_sh_row"))  # one a task leaves before the shuffle
    part = one.withColumn("_sh_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_sh_n") - 1) / HOT_ROWS)))).repartition(*key, "_sh_c")
    end = F.least((F.col("_sh_c") + 1) * HOT_ROWS, F.col("_sh_n")) - 1
    numbered = part.withColumn("_sh_i", F.explode(F.sequence(F.col("_sh_c") * HOT_ROWS, end)))
    return others.unionByName(numbered.select("_sh_row.*", "_sh_e", "_sh_i"))


def shard_rows(df: DataFrame, ids: list[str | Column], shards: int = 24, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``ids``: columns (or expressions) whose hash deals rows to buckets and orders permutations; ``df`` is read four times.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "sharding")
    named = {f"_sh_id{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(ids)}
    order = list(named)
    told = _spread_equal(df, ids, seed, scratch).withColumns(named)
    n = df.count() if buckets is None else None
    p = buckets or int(min(MAX_BUCKETS, max(256, -(-n // ROWS_PER_BUCKET))))
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *order, "_sh_e", "_sh_i")
    keyed = told.withColumns({"_sh_b": F.pmod(h(1), F.lit(p)).cast("int"), "_sh_k": h(2), "_sh_s": h(3)})
    counts = np.zeros(p, np.int64)
    for b, c in keyed.groupBy("_sh_b").count().collect():  # at most MAX_BUCKETS rows
        counts[b] = c
    upto = np.cumsum(draw_matrix(counts, shards, seed), axis=1)
    plan = spark.createDataFrame([(i, [int(x) for x in upto[i]]) for i in range(p)], "_sh_b int, _sh_upto array<long>")
    local = Window.partitionBy("_sh_b").orderBy("_sh_k", "_sh_s", *order, "_sh_e", "_sh_i")
    dealt = (
        keyed.drop("shard", "slot").withColumn("_sh_r", F.row_number().over(local))
        .join(F.broadcast(plan), "_sh_b")  # MAX_BUCKETS rows of ``shards`` counts
        .withColumn("shard", F.size(F.filter("_sh_upto", lambda u: u < F.col("_sh_r"))).cast("int"))
        .drop("_sh_upto", "_sh_r")
    )
    # The second permutation: a random sub-bucket first, then a random order within it.
    dealt = dealt.withColumn("_sh_q", F.pmod(h(4), F.lit(p)).cast("int"))
    inner = Window.partitionBy("shard", "_sh_q").orderBy("_sh_s", "_sh_k", *order, "_sh_e", "_sh_i")
    sizes = dealt.groupBy("shard", "_sh_q").count()
    before = Window.partitionBy("shard").orderBy("_sh_q").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_sh_q", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_sh_start"))
    return (
        dealt.withColumn("_sh_r", F.row_number().over(inner))
        .join(starts, ["shard", "_sh_q"])
        .withColumn("slot", (F.col("_sh_start") + F.col("_sh_r") - 1).cast("long"))
        .drop("_sh_b", "_sh_k", "_sh_s", "_sh_e", "_sh_i", "_sh_q", "_sh_r", "_sh_start", *order)
    )

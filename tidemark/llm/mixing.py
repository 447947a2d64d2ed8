"""Mixing sources to target weights as a min-cost flow over overlapping sources.

Rows of equal text are copies of one document, and the set of sources that hold one is its membership pattern. A pattern
offers the tokens of its documents again and again, each repetition at a higher cost, so copies in several sources share one
count of repetitions. Each source takes tokens up to its quota from the patterns it is in, at most ``repeats`` times those of
its own rows. The cheapest maximal flow over this small network says how many tokens each source takes of each pattern (a
cell). Rows are then selected by a seeded order until the flow of their cell is met: whole epochs for all rows, and one more
for the first ones in that order.

Quotas: sources by code point (null last) have cyclic weights and share all tokens; none takes more than ``repeats`` times
its own tokens, and what is above is shared again by weight.

Only numbers are read: a source, hashes and a size for each row. Texts in several sources are looked up by their hash, a
broadcast up to ``MAX_SPREAD`` of them and a shuffle of narrow rows beyond. Rows of a cell are cumulated in hash buckets whose
number follows the number of rows, and ordered one by one only in the bucket where the cell's flow ends. The driver sees a few numbers
for each cell, as arrays, and solves the whole network whatever its size: all sources of a text share its repetitions. Patterns are told apart by a 64-bit hash.

Defined results: a null text has no words; null source is a source; rows that are equal in all that is hashed are taken
alike; very long texts are numbers like others; an empty table gives no rows. All other columns are carried along; columns
that begin with ``_mx_`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.words import count_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Half of the cells (the network's arcs between patterns and sources) that may be spread to all executors; more are joined by a shuffle.
MAX_ARCS = 160_000
#: Repetitions that have a cost of their own. Beyond, costs rise with each doubling, so they stay convex however many copies a text has.
COST_LEVELS = 64
#: Rows of all cells in one bucket, and the greatest number of buckets (as a power of two).
ROWS_PER_BUCKET, MAX_BITS = 100_000, 16
#: Texts of several sources that may be spread to all executors.
MAX_SPREAD = 1_000_000
#: Rows added or left out at the end, to come nearer to each source's quota.
GAP_ROUNDS = 2
CELL = ["_mx_m", "_mx_s"]


def word_count(text: Column) -> Column:
    return count_words(text, spaced=True)


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_REPEATS, total: int | None = None) -> list[float]:
    """Share ``total`` (the sum of sizes) by cyclic weights; what is above ``cap`` times a size stops there, the excess is shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), float(sum(sizes) if total is None else total), set(range(len(sizes)))
    while free:
        all_w = sum(w[i] for i in sorted(free))
        over = {i for i in free if left * w[i] / all_w > cap * sizes[i]}
        for i in sorted(over or free):
            out[i] = cap * float(sizes[i]) if over else left * w[i] / all_w
        if not over:
            break
        left -= sum(out[i] for i in sorted(over))
        free -= over
    return out


def min_cost_flow(offers: list[list[int]], reach: list[dict[int, int]], quota: list[int]) -> dict[tuple[int, int], int]:
    """Tokens from pattern p to source s, filling quotas as far as they can be, at the least cost.

    ``offers[p][r]``: tokens that p offers at cost r. ``reach[p][s]``: how many of them s can take.

    See ``_flow``, which has the arcs as arrays.
    """
    arcs = sorted((s, p, c) for p, to in enumerate(reach) for s, c in to.items())
    at = np.array(arcs, np.int64).reshape(-1, 3)
    flow = _flow((np.array(level, np.int64) for level in zip_longest(*offers, fillvalue=0)), at[:, 1], at[:, 0], at[:, 2], np.array(quota, np.int64))
    return {(p, s): int(x) for (s, p, _), x in zip(arcs, flow, strict=True) if x}


def _flow(offers: Iterable[np.ndarray], pattern: np.ndarray, source: np.ndarray, reach: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Tokens on each arc. Arcs are sorted by source and, within one, by pattern; ``offers`` has an array over patterns for each cost.

    Costs are on the arcs from the root only. So a cheapest path in the residual network costs what its first arc does, and
    opening the arcs cost by cost, each time up to a maximal flow, gives a maximal flow of least cost. Patterns between two sources are one
    step of a path, over which tokens move from the one source to the other, so searches run over sources, with arrays over arcs.
    """
    begin = np.searchsorted(source, np.arange(len(quota) + 1))
    sent, lack, left = np.zeros(len(pattern), np.int64), quota.copy(), 0
    fill = lambda can, amount: np.clip(amount - (np.cumsum(can) - can), 0, can)  # in the order of arcs

    def enter(s: int):
        """Arcs from patterns with tokens left to ``s``, and what they can take."""
        arcs = slice(begin[s], begin[s + 1])
        return arcs, np.minimum(left[pattern[arcs]], reach[arcs] - sent[arcs])

    def move(a: int, b: int):
        """Arcs to ``a`` and ``b`` of the same patterns, and what can move from the one to the other."""
        off = begin[a] + np.flatnonzero(sent[begin[a] : begin[a + 1]])
        on = begin[b] + np.searchsorted(pattern[begin[b] : begin[b + 1]], pattern[off])
        both = on < begin[b + 1]
        off, on = off[both], on[both]
        both = pattern[on] == pattern[off]
        off, on = off[both], on[both]
        return off, on, np.minimum(sent[off], reach[on] - sent[on])

    def push(path: list[int]) -> None:
        """Tokens from the root over the sources of ``path`` to its last one, as many as it can carry. It is simple, so its steps don't hinder each other."""
        first, can = enter(path[0])
        steps = [move(a, b) for a, b in zip(path, path[1:])]
        amount = min(lack[path[-1]], can.sum(), *[x[2].sum() for x in steps])
        if amount > 0:
            more = fill(can, amount)
            sent[first] += more
            left[pattern[first]] -= more
            for off, on, most in steps:
                x = fill(most, amount)
                sent[off] -= x
                sent[on] += x
            lack[path[-1]] -= amount

    def ways() -> list[list[int]]:
        """Shortest paths to sources that lack tokens."""
        back = np.full(len(quota), -2)
        room = sent < reach
        new = np.unique(source[room & (left[pattern] > 0)])
        back[new] = -1
        via = np.full(len(left), -1)
        while len(new) and not (lack[new] > 0).any():
            front = np.zeros(len(quota), bool)
            front[new] = True
            seen = via >= 0
            arcs = np.flatnonzero(front[source] & (sent > 0))
            arcs = arcs[~seen[pattern[arcs]]]
            via[pattern[arcs]] = source[arcs]
            arcs = np.flatnonzero(room & (back[source] == -2))
            arcs = arcs[~seen[pattern[arcs]] & (via[pattern[arcs]] >= 0)]
            back[source[arcs]] = via[pattern[arcs]]
            new = np.unique(source[arcs])
        out = []
        for s in new[lack[new] > 0].tolist():
            path = [s]
            while back[path[-1]] >= 0:
                path.append(int(back[path[-1]]))
            out.append(path[::-1])
        return out

    for offer in offers:
        left = left + offer
        for s in np.flatnonzero(lack > 0).tolist():
            push([s])
        while (lack > 0).any() and (paths := ways()):
            for path in paths:
                push(path)
        if not (lack > 0).any():
            break
    return sent


def numbers(docs: DataFrame, source: Column, same: Column, ids: list, size: Column | None = None, seed: int = 23) -> DataFrame:
    """``docs`` with what the mix reads: source, hash of the text, place in the seeded order, size."""
    code = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    made = {"_mx_s": code, "_mx_g": F.xxhash64(same), "_mx_h": F.xxhash64(F.lit(seed), *ids, same, code)}
    return docs.withColumns(made | ({} if size is None else {"_mx_n": size.cast("long")}))


@dataclass(frozen=True)
class Mix:
    """``cells``: a row for each cell, with its epochs and where its extra rows end. ``shared``: patterns of texts in several sources."""

    cells: DataFrame
    shared: DataFrame
    few: bool
    bits: int
    small: bool

    def apply(self, rows: DataFrame) -> DataFrame:
        """Rows of ``numbers`` with ``_mx_copies``, ``_mx_source_size`` and ``_mx_target``."""
        cells = F.broadcast(self.cells) if self.small else self.cells  # up to 2 * MAX_ARCS of them
        out = _with_pattern(rows, self.shared, self.few).join(cells, CELL, "left")
        h, b = F.col("_mx_h"), _bucket(self.bits)
        extra = (b < F.col("_mx_end")) | ((b == F.col("_mx_end")) & (h <= F.col("_mx_cut")))
        flipped = (b == F.col("_mx_end")) & F.exists("_mx_flips", lambda x: x == h)
        extra = F.coalesce(extra, F.lit(False)) != F.coalesce(flipped, F.lit(False))
        out = out.withColumn("_mx_copies", (F.col("_mx_epochs") + extra.cast("int")).cast("int"))
        return out.drop("_mx_m", "_mx_epochs", "_mx_end", "_mx_cut", "_mx_flips")


def _bucket(bits: int) -> Column:
    """Buckets in the order of the hash."""
    return F.shiftright("_mx_h", 64 - bits).cast("int") if bits else F.lit(0)


def _with_pattern(rows: DataFrame, shared: DataFrame, few: bool) -> DataFrame:
    out = rows.join(F.broadcast(shared) if few else shared, "_mx_g", "left")
    return out.withColumn("_mx_m", F.coalesce("_mx_m", F.xxhash64(F.array("_mx_s"))))


def _key(code: str) -> tuple[bool, bytes]:
    return code == "", code.encode("utf-32-be", "surrogatepass")


def solve(rows: DataFrame, scratch: Scratch, repeats: int = MAX_REPEATS, weights: tuple[float, ...] = WEIGHTS) -> Mix:
    """The mix of ``rows`` (of ``numbers``, with sizes; a table, since it is read four times)."""
    spark = rows.sparkSession
    rows = rows.select("_mx_s", "_mx_g", "_mx_h", "_mx_n")
    bits = min(MAX_BITS, (rows.count() // ROWS_PER_BUCKET).bit_length())
    # Texts in several sources: two different hashes of sources, found with partial minima and maxima.
    side = F.xxhash64("_mx_s")
    several = rows.groupBy("_mx_g").agg(F.min(side).alias("a"), F.max(side).alias("b")).where("a < b").select("_mx_g")
    several = scratch.write(several, "several")
    few = several.count() <= MAX_SPREAD
    held = rows.join(F.broadcast(several) if few else several, "_mx_g", "left_semi").groupBy("_mx_g", "_mx_s").agg(F.max("_mx_n").alias("n"))
    held = scratch.write(held.groupBy("_mx_g").agg(F.xxhash64(F.array_sort(F.collect_list("_mx_s"))).alias("_mx_m"), F.max("n").alias("n")), "shared")
    once = held.groupBy("_mx_m").agg(F.sum("n").alias("once"))
    shared = held.select("_mx_g", "_mx_m")
    buckets = _with_pattern(rows, shared, few).withColumn("_mx_b", _bucket(bits)).groupBy(*CELL, "_mx_b").agg(F.sum("_mx_n").alias("sum"))
    buckets = scratch.write(buckets, "buckets")

    # As many as the network has arcs.
    found = buckets.groupBy(*CELL).agg(F.sum("sum").alias("tokens")).join(once, "_mx_m", "left").select(*CELL, "tokens", F.coalesce("once", "tokens").alias("once")).toArrow()
    names = found["_mx_s"].combine_chunks().dictionary_encode()
    sources = sorted(names.dictionary.to_pylist(), key=_key)
    number = {s: i for i, s in enumerate(sources)}
    place = np.array([number[s] for s in names.dictionary.to_pylist()], np.int64)
    source = place[names.indices.to_numpy(zero_copy_only=False)]
    keys, pattern = np.unique(found["_mx_m"].to_numpy(), return_inverse=True)
    order = np.lexsort((pattern, source))
    source, pattern = source[order], pattern[order]
    tokens, once = (found[c].to_numpy()[order] for c in ("tokens", "once"))
    own, offered, most = np.zeros(len(sources), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    np.add.at(own, source, tokens)
    np.add.at(most, pattern, repeats * tokens)
    offered[pattern] = once
    share = targets(own.tolist(), weights, repeats)
    flow = _flow(_levels(offered, most), pattern, source, repeats * tokens, np.array([round(x) for x in share], np.int64))
    epochs = np.minimum(flow // np.maximum(tokens, 1), repeats)
    plan = {
        "_mx_m": keys[pattern], "_mx_s": pa.DictionaryArray.from_arrays(pa.array(source), pa.array(sources, pa.string())).cast(pa.string()), "_mx_epochs": epochs.astype(np.int32),
        "_mx_rest": flow - epochs * tokens, "_mx_source_size": own[source], "_mx_target": np.array(share, np.float64)[source],
    }
    plan_df = spark.createDataFrame(pa.table(plan))
    small = len(tokens) <= 2 * MAX_ARCS
    return Mix(scratch.write(_ends(rows, buckets, plan_df, shared, few, bits, small), "cells"), shared, few, bits, small)


def _levels(once: np.ndarray, most: np.ndarray) -> Iterable[np.ndarray]:
    """``_offers`` of all patterns, cost by cost."""
    left, cost = most.copy(), 0
    while left.any():
        now = np.where(once > 0, np.minimum(once << max(0, cost - COST_LEVELS), left), left)
        yield now
        left, cost = left - now, cost + 1


def _offers(once: int, most: int) -> list[int]:
    """Tokens at each cost: one repetition each, then twice as many as before, until all ``most`` tokens are offered."""
    out: list[int] = []
    while most > 0:
        size = once << max(0, len(out) - COST_LEVELS)
        out.append(min(size, most) if once else most)
        most -= out[-1]
    return out


def _ends(rows: DataFrame, buckets: DataFrame, plan: DataFrame, shared: DataFrame, few: bool, bits: int, small: bool) -> DataFrame:
    """``plan`` with the bucket and hash where each cell's rest ends, and the rows next to the end that are flipped to close gaps."""
    before = Window.partitionBy(*CELL).orderBy("_mx_b").rowsBetween(Window.unboundedPreceding, -1)
    summed = buckets.join(F.broadcast(plan) if small else plan, CELL).withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    ends = summed.where("before < _mx_rest and before + sum >= _mx_rest").select(*CELL, F.col("_mx_b").alias("_mx_end"), "before", "_mx_rest")
    inner = _with_pattern(rows, shared, few).join(F.broadcast(ends) if small else ends, CELL).where(_bucket(bits) == F.col("_mx_end"))
    inner = inner.groupBy(*CELL, "_mx_h", "_mx_end", "before", "_mx_rest").agg(F.sum("_mx_n").alias("n"))
    order, whole = Window.partitionBy(*CELL).orderBy("_mx_h"), Window.partitionBy("_mx_s")
    at = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The row that crosses the end is taken if that comes nearer to it; all rows before it are.
    inner = inner.withColumn("extra", F.col("before") + at + F.col("n") / 2 <= F.col("_mx_rest")).withColumn("now", F.col("extra"))
    inner = inner.withColumn("lack", F.when(F.row_number().over(order) == 1, F.col("_mx_rest") - F.col("before")))
    for _ in range(GAP_ROUNDS):
        # Of a source's rows on the wrong side, the one whose size is nearest to what the source lacks or has too much.
        inner = inner.withColumn("gap", F.sum("lack").over(whole) - F.sum(F.when(F.col("now"), F.col("n")).otherwise(0)).over(whole))
        off = F.abs(F.abs("gap") - F.col("n"))
        fits = (F.col("now") == (F.col("gap") < 0)) & (off < F.abs("gap"))
        inner = inner.withColumn("pick", F.min(F.when(fits, F.struct(off.alias("off"), F.col("_mx_m").alias("m"), F.col("_mx_h").alias("h")))).over(whole))
        here = (F.col("pick.h") == F.col("_mx_h")) & (F.col("pick.m") == F.col("_mx_m"))
        inner = inner.withColumn("now", F.col("now") != F.coalesce(here, F.lit(False))).drop("gap", "pick")
    cuts = inner.groupBy(*CELL, "_mx_end").agg(
        F.max(F.when(F.col("extra"), F.col("_mx_h"))).alias("_mx_cut"),
        F.collect_list(F.when(F.col("extra") != F.col("now"), F.col("_mx_h"))).alias("_mx_flips"),  # GAP_ROUNDS at most
    )
    return plan.drop("_mx_rest").join(cuts, CELL, "left")


def mix(docs: DataFrame, source: Column, same: Column, ids: list, size: Column, scratch: Scratch | None = None, seed: int = 23, repeats: int = MAX_REPEATS, weights=WEIGHTS) -> DataFrame:
    """``docs`` with ``epochs_taken`` (how often each row is taken), ``taken`` (its tokens), ``source_size`` and ``target`` of its source.

    These replace columns of the same names. ``same``: what copies have in common, ``ids``: what the seeded order goes by.
    ``docs`` is read five times: give a table of narrow rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rows = numbers(docs, source, same, ids, size, seed)
    out = solve(rows, scratch, repeats, weights).apply(rows)
    made = {"epochs_taken": F.col("_mx_copies"), "taken": F.col("_mx_n") * F.col("_mx_copies"), "source_size": F.col("_mx_source_size"), "target": F.col("_mx_target")}
    return out.withColumns(made).drop(*[c for c in out.columns if c.startswith("_mx_")])

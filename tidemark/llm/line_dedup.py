"""Exact line dedup with levelled sorted runs of line hashes.

The index of known lines is a set of runs: tables of 128-bit line hashes with the document that owns each, bucketed and
sorted by hash. A new batch is reduced to one row per line and merge-joined with every run (its anti-join says which lines are
new). It is written once, as a table whose new lines are a run of level 0. As soon as a level has ``FANOUT`` runs they are merged into one of the next
level, so there are few runs and each line is rewritten once a level.

A batch's own repeats are settled by the least document id. ``dedup_lines`` feeds the documents in ranges of ids, in order, so
the owner is the least id overall. Lines of the documents are joined with the repeated lines only; this join has no
aggregation above it that needs its keys together, so adaptive execution splits hot lines. What is dropped is gathered per
document as line positions.

Defined results: null or empty text is one empty line; a null id counts as the greatest; rows with the same id are one
document for ownership (all keep their lines), and any long is an id; a line that is tied within its document stays where it is
first and again; a very long text is one row; all other columns are carried, but ``n_lines`` and ``n_dropped`` are replaced and
columns that begin with ``_ld_`` are the operator's own; an empty table gives no rows.

The number of batches follows the number of documents, that of a run's buckets the number of lines, so tasks stay of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.words import LOWER, SPACE, UPPER

MIN_CHARS = 10
FANOUT = 2
#: Least and greatest number of batches (powers of two), documents of one, and lines of one bucket of a run.
BATCHES, MAX_BATCHES, DOCS_PER_BATCH, LINES_PER_BUCKET = 4, 64, 50_000_000, 2_000_000
_H = ["_ld_h1", "_ld_h2"]


class LineRuns:
    """The levelled runs. Each is a bucketed table in the shared folder, so joins with it don't shuffle it again.

    A batch's table is its run of level 0 as well: ``_ld_new`` says which of its lines the run adds.
    """

    def __init__(self, scratch: Scratch, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.scratch, self.fanout = scratch.spark, scratch, fanout
        self.dealt = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = buckets or self.dealt
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, df: DataFrame, folder: str | None = None) -> str:
        """A run; its name is also that of an external table of the session's catalog."""
        self.made += 1
        name = f"tidemark_run_{self.scratch.root.rsplit('-', 1)[-1]}_{self.made}"
        self.scratch.write_bucketed(df, folder or name, name, self.buckets, _H)
        return name

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(run).where("_ld_new").select(*_H, "_ld_owner")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def add(self, keys: DataFrame, name: str, last: bool = False) -> DataFrame:
        """Add a batch: one row for each line, with ``_ld_first``, the least document (null: none with an id).

        Returns the batch's lines with ``_ld_owner``, the document that owns the line. ``last``: no merging any more.
        """
        runs = [r for level in self.levels for r in level]
        joined, owners = keys, []
        for i, run in enumerate(runs):
            joined = joined.join(self._read(run).withColumnRenamed("_ld_owner", f"_ld_o{i}"), _H, "left")
            owners.append(F.col(f"_ld_o{i}"))
        known = F.coalesce(*owners) if owners else F.lit(None).cast("long")
        settled = joined.select(*[c for c in keys.columns if c != "_ld_first"], F.coalesce(known, "_ld_first").alias("_ld_owner"), known.isNull().alias("_ld_new"))
        if last:
            return self.scratch.write(settled, name)
        # What aggregations and joins by the same columns have dealt to as many partitions is in its buckets already.
        self._push(0, self._write(settled if self.dealt == self.buckets else settled.repartition(self.buckets, *_H), name))
        return self.scratch.read(name, settled)

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._read(self.levels[level][0])
            for r in self.levels[level][1:]:
                merged = merged.unionByName(self._read(r))
            name = self._write(merged.repartition(self.buckets, *_H).withColumn("_ld_new", F.lit(True)))
            for r in self.levels[level]:
                self._drop(r)
            self.levels[level] = []
            self._push(level + 1, name)

    def clear(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int | None = None) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, ``n_lines`` (before) and ``n_dropped``."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lines")
    ident = F.col(doc).cast("long")
    who = {"_ld_d": F.coalesce(ident, F.lit(0)), "_ld_n": ident.isNull(), "_ld_t": F.xxhash64(text), "_ld_u": F.xxhash64(F.lit(1), text)}
    n, cuts = docs.agg(F.count(F.lit(1)), F.percentile_approx(ident, [i / MAX_BATCHES for i in range(1, MAX_BATCHES)], 10_000)).first()
    batches = batches or min(MAX_BATCHES, max(BATCHES, 1 << (n // DOCS_PER_BATCH).bit_length()))
    bounds = sorted({cuts[i * MAX_BATCHES // batches - 1] for i in range(1, batches)}) if cuts else []
    number = F.when(F.col("_ld_n"), len(bounds)).otherwise(sum([(F.col("_ld_d") > F.lit(b)).cast("int") for b in bounds], F.lit(0)))
    exploded = docs.select(*[c.alias(k) for k, c in who.items()], F.posexplode(_lines(F.col(text))).alias("_ld_pos", "_ld_line"))
    key = exploded.withColumn("_ld_key", line_key(F.col("_ld_line"))).where(F.char_length("_ld_key") >= min_chars)
    hashed = key.select(*who, "_ld_pos", F.xxhash64("_ld_key").alias(_H[0]), F.xxhash64(F.lit(1), "_ld_key").alias(_H[1]))
    lines = scratch.write(hashed.withColumn("_ld_batch", number.cast("int")), "hashed", partition_by="_ld_batch")  # texts are split once
    own = F.when(~F.col("_ld_n"), F.col("_ld_d"))
    firsts = [F.min(own).alias("_ld_first"), F.max(own).alias("_ld_last"), F.max("_ld_n").alias("_ld_none")]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_PER_BUCKET)
    runs, repeated = LineRuns(scratch, buckets=buckets), []
    try:
        for b in range(len(bounds) + 1):
            keys = lines.where(F.col("_ld_batch") == b).groupBy(*_H).agg(*firsts)
            settled = runs.add(keys, f"batch{b}", last=b == len(bounds))
            repeated.append(settled.where("_ld_none or _ld_last > _ld_owner").select(F.lit(b).alias("_ld_batch"), *_H, "_ld_owner"))
    finally:
        runs.clear()
    again = repeated[0]
    for r in repeated[1:]:
        again = again.unionByName(r)
    # A line without an owner is one of rows without an id only.
    dropped = lines.join(again, ["_ld_batch", *_H]).where("_ld_owner is not null and (_ld_n or _ld_d > _ld_owner)").select(*who, "_ld_pos")
    drops = scratch.write(dropped.groupBy(*who).agg(F.array_sort(F.collect_set("_ld_pos")).alias("_ld_drops")), "drops")
    scratch.drop("hashed", *[f"batch{b}" for b in range(len(bounds) + 1)])
    out = docs.withColumns(who).join(drops, list(who), "left").drop(*who)
    out = out.withColumns({"_ld_lines": _lines(F.col(text)), "_ld_at": F.concat(F.array(F.lit(-1)), F.coalesce("_ld_drops", F.array().cast("array<int>")), F.array(F.size(_lines(F.col(text)))))})
    lines_col, at = F.col("_ld_lines"), F.col("_ld_at")
    # The lines between two dropped ones, for all of them: linear in the number of lines.
    between = lambda k: F.slice(lines_col, at[k] + 2, at[k + 1] - at[k] - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - 2), between)), "\n")
    return out.withColumns(
        {
            text: F.when(F.col("_ld_drops").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept),
            "n_lines": F.size("_ld_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_ld_drops"), F.lit(0)).cast("long"),
        }
    ).drop("_ld_drops", "_ld_lines", "_ld_at")


ORACLE = f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id > o.owner, false) AS dropped FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

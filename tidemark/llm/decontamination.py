"""Benchmark decontamination by winnowed fingerprints.

Both sides are winnowed: of every ``SPAN - GRAM + 1`` consecutive ``GRAM``-word hashes the least one is kept (the last of
equals), so two texts that share ``SPAN`` words in a row keep a common fingerprint there. Items shorter than ``SPAN`` words
are windows by themselves: their fingerprint is the hash of all their words, and documents give those of their word
sequences of just these lengths (``SPAN - 1`` lengths at most, none if there is no such item).

1. Items of equal words become one class. Its windows and fingerprints are tables.
2. Fingerprints of documents are joined with those of the items in Spark. What is left is a list of hits by text.
3. Only texts with hits are read again, each once whatever its copies: around each hit the windows of ``SPAN`` words that
   contain it are joined with the items' windows word by word. That extends a hit to every shared span, and hash collisions go.
4. Spans and items are gathered by text and joined with the documents by the hash of the text.

Fingerprints, windows and results are spread to all executors up to a checked number and joined by a shuffle beyond. These
shuffles carry hashes and windows, no texts but those with hits; a window that very many documents share is one key of a join
without an aggregation above, so adaptive execution splits it.

Defined results: null texts have no words; an item without words has no window; equal items count as items each; repeated
documents are judged each, and null or repeated ids are carried; very long texts are whole in one task; an empty benchmark
leaves all documents clean, an empty table gives no rows. Columns that begin with ``_dc_`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.words import ALNUM_WORD, LOWER, UPPER, Words, blocks, count_words, gram_hashes, gram_hashes_at, mix, split_words

SPAN, GRAM = 10, 5
#: Rows that may be spread to all executors: fingerprints and text hashes, and windows or results of about a hundred bytes.
MAX_SPREAD, MAX_SPREAD_WIDE = 1_000_000, 200_000
TEXT = ["_dc_1", "_dc_2"]


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: of every ``window`` consecutive hashes the least, the last of equals; of fewer hashes one."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(window, n)
    m = n - width + 1
    best, at = grams[:m].copy(), np.arange(m)
    for j in range(1, width):
        other = grams[j : j + m]
        better = other <= best
        at[better] = np.flatnonzero(better) + j
        np.minimum(best, other, out=best)
    return np.unique(at)


def _of_length(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of short items are told apart by length."""
    return mix(hashes ^ np.uint64(n))


def _kept(words: Words, a: int, b: int, grams: np.ndarray) -> np.ndarray:
    """Positions of the winnowed fingerprints of the words a to b of a batch."""
    return winnow(grams[a : b - GRAM + 1], SPAN - GRAM + 1) if b - a >= SPAN else np.zeros(0, np.int64)


def prints(words: Words, a: int, b: int, grams: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The fingerprints of the words a to b: winnowed, and of all word sequences of the given lengths."""
    parts = [grams[a + _kept(words, a, b, grams)]]
    parts += [_of_length(gram_hashes(words.hash[a:b], n), n) for n in lengths]
    return np.unique(np.concatenate(parts))


def places(words: Words, a: int, b: int, grams: np.ndarray, lengths: list[int], hits: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Lengths and starts of the windows that contain a hit (``hits``: sorted fingerprints)."""
    kept = _kept(words, a, b, grams)
    kept = kept[_among(grams[a + kept], hits)]
    starts = np.unique((kept[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
    out = [(SPAN, starts[(starts >= 0) & (starts <= b - a - SPAN)])]
    return out + [(n, np.flatnonzero(_among(_of_length(gram_hashes(words.hash[a:b], n), n), hits))) for n in lengths]


def _among(values: np.ndarray, found_in: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(found_in) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found_in, values)
    at[at == len(found_in)] = 0
    return found_in[at] == values


def _batches(texts: list) -> Iterator[tuple[int, Words, int, int, np.ndarray]]:
    """Number, words and grams of each text."""
    for x, y in blocks(texts):
        words = split_words(texts[x:y], spaced=False)
        grams = gram_hashes(words.hash, GRAM)
        for k in range(y - x):
            yield x + k, words, int(words.first[k]), int(words.first[k + 1]), grams


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _items(benchmark: DataFrame, item: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of items of equal words (``c``, ``text``, ``ids``), and their windows (``c``, ``n``, ``x``)."""
    normal = F.array_join(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(ALNUM_WORD), F.lit(0)), " ")
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), normal.alias("text")).where("text <> ''")
    classes = rows.groupBy("text").agg(F.collect_list("id").alias("ids")).withColumn("c", F.monotonically_increasing_id())
    classes = scratch.write(classes, "items")
    words = F.split("text", " ")
    cut = classes.select("c", words.alias("w"), F.least(F.size(words), F.lit(SPAN)).alias("n"))
    cut = cut.select("c", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    return classes, scratch.write(cut.select("c", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("x")).distinct(), "windows")


def _hits(texts: DataFrame, classes: DataFrame, lengths: list[int], scratch: Scratch) -> DataFrame:
    """The fingerprint join: ``p`` of the texts (hashes of text, ``text``) that an item has too.

    The items' side is the table ``prints``; there are also the hashes of their windows (``window``).
    """

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            for _, words, a, b, grams in _batches(list(pdf["text"])):
                parts[0].append(prints(words, a, b, grams, [b - a] if b - a < SPAN else []))
                parts[1].append(gram_hashes(words.hash[a:b], min(b - a, SPAN)))
            for window, x in enumerate(parts):
                yield pd.DataFrame({"p": np.unique(np.concatenate(x)).view(np.int64)}).assign(window=bool(window))

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [prints(words, a, b, grams, lengths).view(np.int64) for _, words, a, b, grams in _batches(list(pdf["text"]))]
            yield pdf[TEXT].assign(p=found)

    made = scratch.write(classes.select("text").mapInPandas(of_items, "p long, window boolean").distinct(), "prints")
    own = made.where("not window").select("p")
    each = texts.mapInPandas(of_texts, "_dc_1 long, _dc_2 long, p array<long>").select(*TEXT, F.explode("p").alias("p"))
    found = each.join(F.broadcast(own) if own.count() <= MAX_SPREAD else own, "p", "left_semi")
    return scratch.write(found.groupBy(*TEXT).agg(F.collect_set("p").alias("p")), "hits")


def _matches(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Windows of items in texts: hashes of the text, ``n``, ``starts``, ``c``; and the items' classes."""
    classes, windows = _items(benchmark, item, item_text, scratch)
    lengths = sorted(r["n"] for r in windows.where(F.col("n") < SPAN).select("n").distinct().collect())  # at most SPAN - 1
    texts = docs.select(*_hashes(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hits = _hits(texts, classes, lengths, scratch)
    n, keys = hits.count(), hits.select(*TEXT)
    tasks = 1 + min(n // 256, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    again = texts.join(F.broadcast(keys) if n <= MAX_SPREAD else keys, TEXT, "left_semi")
    again = again.repartition(tasks, *TEXT).dropDuplicates(TEXT).join(hits, TEXT)
    # Windows that can't match are left out by their hash, if those of all items can be spread.
    ends = scratch.read("prints", docs.sparkSession.createDataFrame([], "p long, window boolean")).where("window").select("p")
    known = np.sort(np.array([r[0] for r in ends.collect()], np.int64).view(np.uint64)) if ends.count() <= MAX_SPREAD else None
    spread = docs.sparkSession.sparkContext.broadcast(known)

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            t1, t2, found_in = pdf[TEXT[0]].to_numpy(), pdf[TEXT[1]].to_numpy(), spread.value
            for k, words, a, b, grams in _batches(list(pdf["text"])):
                own = np.sort(np.asarray(pdf["p"].iloc[k], np.int64).view(np.uint64))
                found: dict[tuple[int, bytes], list[int]] = {}
                for n, starts in places(words, a, b, grams, lengths, own):
                    if found_in is not None:
                        starts = starts[_among(gram_hashes_at(words.hash, a + starts, n), found_in)]
                    for s in starts.tolist():
                        found.setdefault((n, b" ".join(words.word(a + s + j) for j in range(n))), []).append(s)
                rows += [(t1[k], t2[k], n, x.decode(), s) for (n, x), s in found.items()]
            yield pd.DataFrame(rows, columns=[*TEXT, "n", "x", "starts"])

    near = again.mapInPandas(extend, "_dc_1 long, _dc_2 long, n int, x string, starts array<int>")
    few = windows.count() <= MAX_SPREAD_WIDE
    return scratch.write(near.join(F.broadcast(windows) if few else windows, ["n", "x"]).select(*TEXT, "n", "starts", "c"), "matches"), classes


def _hashes(text: str) -> list:
    return [F.xxhash64(text).alias(TEXT[0]), F.xxhash64(F.lit(1), text).alias(TEXT[1])]


def find_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``spans`` (hit word spans: from, to) and ``items`` (ids as strings).

    These replace columns of the same names.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    matches, classes = _matches(docs, benchmark, text, item, item_text, scratch)
    one = F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("n")).alias("e")))
    # Several items can have one window: it is one row by then.
    spans = matches.select(*TEXT, one.alias("one")).distinct().groupBy(*TEXT).agg(F.flatten(F.collect_list("one")).alias("spans"))
    merge = F.pandas_udf(lambda s: s.map(lambda x: _merge([(y["s"], y["e"]) for y in x])), "array<struct<s:int,e:int>>")
    names = matches.select(*TEXT, "c").distinct().join(classes.select("c", "ids"), "c").groupBy(*TEXT)
    names = names.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    found = scratch.write(spans.withColumn("spans", merge("spans")).join(names, TEXT), "found")
    wide = found.agg(F.sum(8 * F.size("spans") + 16 * F.size("items") + F.octet_length(F.array_join("items", "")))).first()[0] or 0
    keep = [c for c in docs.columns if c not in (text, "n_words", "spans", "items")]
    count = count_words(F.col(text), spaced=False).alias("n_words")
    out = docs.select(*keep, *_hashes(text), count).join(F.broadcast(found) if wide <= 100 * MAX_SPREAD_WIDE else found, TEXT, "left").drop(*TEXT)
    return out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in (("spans", "array<struct<s:int,e:int>>"), ("items", "array<string>"))})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    found = scratch.write(_matches(docs, benchmark, text, item, item_text, scratch)[0].select(*TEXT).distinct(), "found")
    scratch.drop("items", "windows", "prints", "hits", "matches")
    rows = docs.select(F.struct("*").alias("_dc_row"), *_hashes(text))
    return rows.join(F.broadcast(found) if found.count() <= MAX_SPREAD else found, TEXT, "left_anti").select("_dc_row.*")


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Numbers and a digest of the items of each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(
        doc,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least({SPAN}, len(w)) AS n FROM (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
k AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN k ON len(w) >= n)),
h AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

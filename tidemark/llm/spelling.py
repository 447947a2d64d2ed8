"""Spelling variants: words that differ by one code point, each led to the far more frequent word that it is a form of.

1. Words are counted where the texts are read: a bounded table in each task, summed in Spark.
2. Symmetric deletion: every word emits itself and its distinct single deletions, as hashes; an equi-join on them brings near words together.
   A deletion carries the places that give it, so words that share it by different places, which differ twice, don't leave the join.
3. Exact verification on the words themselves at the place that the join gave, in time linear in their length, then one aggregation gives each word its near words' number and its form.
4. Forms lead to forms; roots come by joining the pointers with themselves, each round doubling their reach.

A key is shared by the words that one inserted code point makes of it, so by no more than its length and alphabet allow; a word as long as a
text emits 8-byte hashes, not copies. Words of a count are a few rows; nothing is collected or broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.words import mix

#: Fewest code points and occurrences of a word, and by what factor its form is more frequent.
LEAST_CHARS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One of so many (document, run) pairs loses a code point.
SLIP = 199
#: Entries and characters of a task's table of counts before it is handed on.
TABLE_WORDS, TABLE_CHARS = 200_000, 1 << 24
#: Characters whose deletions are made at once.
SPELL_CHARS = 1 << 20
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xF1357AEA2E62A9C5)]


def slip(run: str, seed: int) -> str:
    """The run, or without one code point: ``seed`` is the checksum of the document's id and a colon."""
    h = zlib.crc32(run.encode(), seed)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``word`` and ``n`` (occurrences) of all whole texts of (``doc_id``, ``text``); null texts have none.

    Runs of fewer code points than a word needs can't become one and are not looked at. A null id counts as an empty one.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def table(totals: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(totals), dtype=object), "n": pd.Series(list(totals.values()), dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, chars = Counter(), 0
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, so A-Z only
                for found, n in Counter(runs.findall(lowered)).items():
                    word = slip(found, seed)
                    if len(word) >= least_chars:
                        if word not in totals:
                            chars += len(word)
                        totals[word] += n
            if len(totals) > TABLE_WORDS or chars > TABLE_CHARS:
                yield table(totals)
                totals, chars = Counter(), 0
        yield table(totals)

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spell(words: list[str]) -> tuple[np.ndarray, ...]:
    """Keys of each word and of its distinct single deletions: the word's index, two hashes, and the first and last place that gives the deletion.

    A hash sums a mixed number of each code point and its place, so that of a deletion is a prefix's sum and that of a suffix moved by one.
    The word itself has all places.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - start[owner]
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    # A run of one letter gives one deletion, whichever of its places goes.
    heads = np.flatnonzero((place == 0) | (c != np.roll(c, 1)))
    ends = np.append(heads[1:], len(c)) - 1
    keys = []
    for k1, k2 in (_K[:2], _K[2:]):
        term = lambda at: mix(mix(c * k1) + at.astype(np.uint64) * k2)  # noqa: B023, E731
        own, moved = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (term(place), term(place - 1)))
        w = owner[heads]
        stop = (start + size)[w]
        keys.append(np.concatenate([own[start + size] - own[start], own[heads] - own[start[w]] + moved[stop] - moved[heads + 1]]))
    whole = np.full(len(words), 0)
    return (
        np.concatenate([np.arange(len(words)), owner[heads]]), keys[0].view(np.int64), keys[1].view(np.int64),
        np.concatenate([whole, place[heads]]), np.concatenate([whole + np.iinfo(np.int32).max, place[ends]]),
    )


def _keys(words: DataFrame) -> DataFrame:
    """``id`` and keys of each row of (``id``, ``word``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, listed = pdf["id"].to_numpy(), pdf["word"].tolist()
            cuts = np.cumsum(list(map(len, listed))) // SPELL_CHARS
            for part in np.split(np.arange(len(listed)), np.flatnonzero(np.diff(cuts)) + 1):
                at, k1, k2, low, high = spell([listed[i] for i in part])
                for i in range(0, len(at), SPELL_CHARS):
                    j = slice(i, i + SPELL_CHARS)
                    yield pd.DataFrame({"id": ids[part][at[j]], "k1": k1[j], "k2": k2[j], "low": low[j].astype(np.int32), "high": high[j].astype(np.int32)})

    return words.select("id", "word").mapInPandas(run, "id long, k1 long, k2 long, low int, high int")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of near words of (``id``, ``word``, ``n``), each once in either direction: ``id``, ``n``, and ``near_id``, ``near``, ``near_n``."""
    keys = scratch.write(_keys(words), "keys")
    left, right = (keys.select("k1", "k2", F.col("id").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ab")
    met = left.join(right, ["k1", "k2"]).where("a < b and low_a <= high_b and low_b <= high_a").select("a", "b", F.greatest("low_a", "low_b").alias("at"))
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    seen = met.join(side("a"), "a").join(side("b"), "b")
    # Without the code point at that place they must be equal; a word that is another's deletion stays as it is.
    longer = F.length("word_a") - F.length("word_b")
    rest = lambda x, whole: F.when(whole, F.col(f"word_{x}")).otherwise(F.concat(F.substring(f"word_{x}", F.lit(1), F.col("at")), F.substring(f"word_{x}", F.col("at") + 2, F.length(f"word_{x}"))))
    seen = seen.where(F.abs(longer) <= 1).where(rest("a", longer < 0) == rest("b", longer > 0))
    one = lambda x, y: F.struct(F.col(x).alias("id"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near_id"), F.col(f"word_{y}").alias("near"), F.col(f"n_{y}").alias("near_n"))
    return seen.select(F.explode(F.array(one("a", "b"), one("b", "a"))).alias("p")).select("p.*")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``id`` and ``root_id`` of rows (``id``, ``form_id``): a form is more frequent by a factor, so chains end, and are at most as long as its logarithm."""
    at = scratch.write(forms.select("id", F.col("form_id").alias("root_id")), "roots0")
    i = 0
    while True:
        i += 1
        ahead = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        moved = scratch.write(at.join(ahead, "root_id", "left").select("id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved")), f"roots{i}")
        scratch.drop(f"roots{i - 1}")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, scratch: Scratch | None = None, factor: int = FACTOR) -> DataFrame:
    """One row for each word of (``doc_id``, ``text``): ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words have at least 6 code points and 5 occurrences over all texts. Near words differ by exactly one inserted, deleted or replaced code
    point. The form is the near word of the largest count (of equal counts the least in order of code points) if that is at least ``factor``
    times the word's own, and the root is where forms lead in the end. Repeated rows count again; other columns are not read; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "spelling")
    counted = count_words(docs).where(F.col("n") >= LEAST_COUNT)
    words = scratch.write(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")  # ids are fixed by the table
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near", "near_id"))
    near = scratch.write(near_pairs(words, scratch).groupBy("id", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    scratch.drop("keys")
    formed = -F.col("best.m") >= factor * F.col("n")
    led = roots(near.where(formed).select("id", F.col("best.near_id").alias("form_id")), scratch)
    named = led.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    form = near.select("id", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n"))
    out = words.join(form, "id", "left").join(named, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))

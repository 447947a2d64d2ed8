"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (1 to 3 characters of lower-cased words, with a mark at word borders), in
order. A text is compared by its own most frequent n-grams: each one adds how far its rank is out of place, or the longest
distance where the profile lacks it. The language with the least sum wins (ties: the first by name).

Profiles are counted over all labelled texts given to ``learn``; a profile is ``TOP`` n-grams, so what is broadcast is
``TOP`` numbers for each language (``MAX_LANGUAGES``, checked).

Defined results: null text, or text without a letter: ``und`` with score 0; without any profile as well. Rows with a null
label or null text teach nothing. Score: one minus the mean distance as a share of the longest. Whole texts are counted,
whatever their length. Rows are never dropped or multiplied, equal ones are judged alike, and ids play no part; an empty table gives no
rows. Other columns are carried along, but ``lang_pred`` and ``score`` are replaced, and ``_lid_found`` is the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import blocks

TOP = 300
MAX_LANGUAGES = 1000
UND = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    if not _TABLE:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(out)
    return _TABLE[0]


def _grams(texts: list[str]) -> Iterator[np.ndarray]:
    """The n-grams of each text as 32-bit numbers; empty for a text without a letter.

    Numbers of one and two characters can't meet those of three in practice: all are hashed to 32 bits.
    """
    table = _letters()
    for text in texts:
        c = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        on = c != 0
        if not on.any():
            yield np.zeros(0, np.uint32)
            continue
        # One border mark (0) before, between and after words: drop the others.
        keep = on.copy()
        keep[1:] |= on[:-1]
        c = np.concatenate([np.zeros(1, np.uint32), c[keep], np.zeros(1, np.uint32)])
        x = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        two = x[:-1] * np.uint32(0x85EBCA6B) ^ (x[1:] >> np.uint32(3)) + x[1:]
        three = two[:-1] * np.uint32(0xC2B2AE35) ^ (x[2:] >> np.uint32(5)) + x[2:]
        a, b, d = c[:-1], c[1:], c[2:]
        both = (a != 0) | (b != 0)
        yield np.concatenate([x[c != 0], two[both], three[(b[:-1] != 0) | ((c[:-2] != 0) & (d != 0))]])


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(grams)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
    return s[at], np.diff(np.concatenate([at, [len(s)]]))


def _ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order; ties by the greater code."""
    key = (counts.astype(np.uint64) << np.uint64(32)) | codes
    if len(key) > top:
        key = key[np.argpartition(key, len(key) - top)[-top:]]
    return (np.sort(key)[::-1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def learn(labelled: DataFrame, text: str, label: str, top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of each label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of a partition: merged as they grow, so memory follows the number of different n-grams."""
        have: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("label")["text"]:
                texts = list(texts)
                for a, b in blocks(texts, 1 << 20):
                    parts = [have[lang]] if lang in have else []
                    parts.append(_counts(np.concatenate(list(_grams(texts[a:b])))))
                    codes, each = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    order = np.argsort(codes, kind="stable")
                    codes, each = codes[order], each[order]
                    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
                    have[lang] = codes[at], np.add.reduceat(each, at) if len(at) else each
        for lang, (codes, each) in have.items():
            yield pd.DataFrame({"label": lang, "code": codes.astype(np.int64), "n": each.astype(np.int64)})

    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label is not null and text is not null")
    counts = rows.mapInPandas(count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    # Most frequent first: at most ``top`` rows of each task come together for a label.
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), F.desc("code")))).where(F.col("r") <= top)
    found = best.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "code"))).alias("p")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["label"]: np.array([x["code"] for x in r["p"]], np.uint32) for r in sorted(found, key=lambda r: r["label"])}


def predictor(profiles: dict[str, np.ndarray], top: int = TOP):
    """A function from texts to (language, score) pairs."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, np.uint32)
    ranks = np.full((len(known) + 1, len(names)), -1, np.int32)  # the last row: in no profile
    for j, n in enumerate(names):
        ranks[np.searchsorted(known, profiles[n]), j] = np.arange(len(profiles[n]))

    def predict_texts(texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for grams in _grams([t or "" for t in texts]):
            if not len(grams) or not names:
                out.append((UND, 0.0))
                continue
            mine = _ranked(*_counts(grams), top)
            at = np.searchsorted(known, mine)
            at[at == len(known)] = 0
            at[known[at] != mine] = len(known)
            r = ranks[at]
            far = np.where(r < 0, top, np.abs(r - np.arange(len(mine))[:, None])).sum(axis=0)
            best = int(far.argmin())
            out.append((names[best], 1.0 - float(far[best]) / (top * len(mine))))
        return out

    return predict_texts


def predict(df: DataFrame, text: str, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = predictor(profiles, top)
        for s in batches:
            yield pd.DataFrame(run(list(s)), columns=["lang_pred", "score"])

    made: Column = udf(F.col(text))
    return df.withColumn("_lid_found", made).withColumns({"lang_pred": F.col("_lid_found.lang_pred"), "score": F.col("_lid_found.score")}).drop("_lid_found")

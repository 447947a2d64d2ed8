"""MinHash document fingerprints.

A text is the set of its five-word shingles (fewer words: the whole sequence; none: the empty set). Each of
``PERMUTATIONS`` universal hash functions (multiply and add, modulo 2^64) keeps its least value over the set; the fingerprint
holds ``BITS`` middle bits of each. Two fingerprints agree in a share of places that estimates the Jaccard similarity.

``similar_classes`` joins signature bands in Spark and verifies the Jaccard similarity of the shingle sets: equal sets are one
class, and all classes that share a band are compared. A band of more than ``jaccard_join.HOT`` classes is a block: its classes meet
chunk by chunk in tasks of bounded size, and only links that join two parts of a block leave it. Links go through connected
components.

``edited_likeness`` compares each text with an edited text that takes its end from the next document. Neighbours come by
sorting within ranges of ids: one shuffle of the texts. Range bounds are ids that occur, so the first row of a range is
known beforehand and is sent to its neighbour as well. An id that very many rows have, and rows without an id, are one range:
it is read in a stream, so it costs time, not memory. The shingles that a text and its edited text begin with are hashed once for
both: a signature is the least of its parts' signatures.

``fingerprint_documents`` does both: one pass over the texts gives fingerprints and set digests, as a table that the classes and the
result come from; bands are those of the fingerprints. Only texts of candidate classes are read again.

Defined results: null text is empty text; rows with equal ids are ordered by a hash of the text, equal texts in any order;
null ids come last (least), and any long is an id; with one document, it is its own next; repeated rows are rows of their own; a
very long text is one row; other columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join
from tidemark.llm.scratch import Scratch
from tidemark.llm.words import blocks, shingle_lists

SHINGLE, PERMUTATIONS, BITS = 5, 128, 16
#: Rows of the signature in a band: 32 bands of 4 miss a pair of similarity 0.8 about once in 10^7.
BAND_ROWS, SIMILAR_PERCENT = 4, 80
#: Shingles whose permutations are taken at once: fits a core's cache.
STEP = 16_384
#: Texts of one range, in rows: some seconds of work. Ranges are read in a stream, so this bounds nothing but their number.
ROWS_PER_RANGE = 2048
MAX_RANGES = 65_536
_RNG = np.random.Generator(np.random.PCG64(20_011))
_A = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each permutation over each set (the largest number for an empty set)."""
    out = np.full((len(sets), PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    size = np.array([len(s) for s in sets])
    for group in _groups(size):
        x = np.concatenate([sets[i] for i in group])
        starts = np.cumsum(size[group]) - size[group]
        buf = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _A[p], out=buf)
            np.add(buf, _B[p], out=buf)
            out[group, p] = np.minimum.reduceat(buf, starts)
    return out


def pair_signatures(own: list[np.ndarray], changed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of both lists of shingles; what the two of a pair begin with is hashed once."""
    same = [_shared_start(x, y) for x, y in zip(own, changed, strict=True)]
    heads = signatures([x[:k] for x, k in zip(own, same, strict=True)])
    tails = signatures([x[k:] for x, k in zip(own, same, strict=True)]), signatures([y[k:] for y, k in zip(changed, same, strict=True)])
    return np.minimum(heads, tails[0]), np.minimum(heads, tails[1])


def _shared_start(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    unlike = x[:n] != y[:n]
    return int(unlike.argmax()) if unlike.any() else n


def _groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of sets that aren't empty, of about ``STEP`` elements."""
    at = np.flatnonzero(size)
    if len(at):
        run = (np.cumsum(size[at]) - 1) // STEP
        yield from np.split(at, np.flatnonzero(np.diff(run)) + 1)


def codes(sig: np.ndarray) -> np.ndarray:
    """What a fingerprint holds: bits 24 to 39. The high bits of each least value are all small, the middle ones tell values apart."""
    return ((sig >> np.uint64(24)) & np.uint64(2**BITS - 1)).astype(np.uint16)


def to_bytes(code: np.ndarray) -> list[bytes]:
    return [row.astype(">u2").tobytes() for row in code]


def packed(own: np.ndarray, changed: np.ndarray) -> list[bytes]:
    """Each of ``changed`` beside its ``own``: a bit for each place that differs, then the values there."""
    unlike = own != changed
    return [bits.tobytes() + b for bits, b in zip(np.packbits(unlike, axis=1), (c[u].astype(">u2").tobytes() for c, u in zip(changed, unlike, strict=True)), strict=True)]


def unpacked(own: bytes, change: bytes) -> bytes:
    out, head = np.frombuffer(own, ">u2").copy(), PERMUTATIONS // 8
    out[np.unpackbits(np.frombuffer(change[:head], np.uint8)).astype(bool)] = np.frombuffer(change[head:], ">u2")
    return out.tobytes()


def to_text(code: np.ndarray) -> list[str]:
    return [b.hex() for b in to_bytes(code)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edit(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    parts = [codes(signatures(shingle_lists(texts[a:b], SHINGLE))) for a, b in blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def _bounds(docs: DataFrame, doc: str) -> tuple[list[int], int | None]:
    """Ids that occur and cut all ids into ranges of about ``ROWS_PER_RANGE`` rows, and the greatest id."""
    n, top = docs.agg(F.count(doc), F.max(doc)).first()
    k = min(MAX_RANGES, n // ROWS_PER_RANGE)
    if k < 1:
        return [], top
    at = [i / (k + 1) for i in range(1, k + 1)]
    return sorted(set(docs.agg(F.percentile_approx(doc, at, 100_000)).first()[0])), top


def _range_of(at: Column, bounds: list[int]) -> tuple[Column, Column]:
    """How many bounds are below a number, and whether it is a bound: two levels, so that a row passes about twice the square root of their number."""
    if not bounds:
        return F.lit(0), F.lit(False)
    width = max(1, int(len(bounds) ** 0.5))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")  # one literal in the plan
    below = lambda xs: F.size(F.filter(xs, lambda v: v < at))
    skipped = below(longs(bounds[width - 1 :: width])) * width
    number = F.coalesce(skipped + below(F.slice(longs(bounds), skipped + 1, width)), F.lit(0))
    return number, F.coalesce(F.get(longs(bounds), number) == at, F.lit(False))


def _compared(own: DataFrame) -> DataFrame:
    """One pass over the texts (``own`` as of ``jaccard_join.identified``): what ``edited_likeness`` gives, in bytes and packed, with ``t`` (of null text, that of the
    empty one), and what classes need."""
    rows = own.select(F.when(~F.col("no"), F.col("doc")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, top = _bounds(rows, "doc")
    at = F.col("doc")
    # Range r holds ids above bounds[r-1] up to bounds[r]; after its last row comes bounds[r-1], the first row of range r-1.
    number, is_bound = _range_of(at, bounds)
    wrapped = at.eqNullSafe(F.lit(top).cast("long"))
    target = lambda r, copy: F.struct(r.cast("int").alias("r"), F.lit(copy).alias("copy"))
    to = F.array_compact(F.array(target(number, False), F.when(is_bound, target(number + 1, True)), F.when(wrapped, target(F.lit(0), True))))
    # Numbers that can be null go to the workers with a flag: as floats they would lose digits.
    dealt = rows.withColumn("_to", F.explode(to)).select("_to.r", "_to.copy", "doc", "text", F.xxhash64("text").alias("t"))
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("r")).sortWithinPartitions("r", "copy", F.desc_nulls_last("doc"), "t")
    ordered = ordered.select("r", "copy", "text", F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("no"), "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Holds back the last row of what has come, until its next one is there."""
        held: tuple | None = None
        done: int | None = None  # the range whose copies have begun: its last row is complete
        for pdf in batches:
            pairs: list[tuple] = []
            keys = zip(pdf["doc"], pdf["no"], pdf["t"], strict=True)
            for r, copy, key, t in zip(pdf["r"], pdf["copy"], keys, pdf["text"], strict=True):
                if copy:
                    if done != r and held is not None:
                        pairs.append((*held, t))
                        held = None
                    done = r
                else:
                    if held is not None:
                        pairs.append((*held, t))
                    held = (key, t)
            yield from _compare(pairs)

    made = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return jaccard_join.with_ids(ordered.mapInPandas(run, f"doc long, no boolean, t long, {made}, {_DESCRIBED}"))


def _results(rows: DataFrame, *more) -> DataFrame:
    whole = F.pandas_udf(lambda own, change: pd.Series([unpacked(x, y) for x, y in zip(own, change, strict=True)], dtype=object), "binary")
    text = lambda c, name: F.lower(F.hex(c)).alias(name)
    edited = text(whole("fingerprint", "edited_fingerprint"), "edited_fingerprint")
    return rows.select(F.col("doc").alias("doc_id"), "n_chars", text("edited_sha256", "edited_sha256"), text("fingerprint", "fingerprint"), edited, "near_edited", "near_next", *more)


def edited_likeness(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; see the module."""
    return _results(_compared(jaccard_join.identified(docs, doc, text)))


def _compare(pairs: list[tuple]) -> Iterator[pd.DataFrame]:
    texts, following = [p[1] for p in pairs], [p[2] for p in pairs]
    if not pairs:
        return
    for a, b in blocks(texts):
        edited = [edit(t, f) for t, f in zip(texts[a:b], following[a:b], strict=True)]
        grams = shingle_lists(texts[a:b], SHINGLE)
        sig, other = pair_signatures(grams, shingle_lists(edited, SHINGLE))
        own, changed = codes(sig), codes(other)
        # Rows follow each other: the next text's fingerprint is mostly there already.
        last = fingerprint_texts([following[b - 1]])
        nxt = np.concatenate([own[1:], last])
        for i in range(b - a - 1):
            if following[a + i] is not texts[a + i + 1]:
                nxt[i] = fingerprint_texts([following[a + i]])[0]
        yield pd.DataFrame(
            {
                **{c: [p[0][i] for p in pairs[a:b]] for i, c in enumerate(("doc", "no", "t"))},
                "n_chars": [len(t) for t in texts[a:b]],
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest() for e in edited],
                "fingerprint": to_bytes(own),
                "edited_fingerprint": packed(own, changed),
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, nxt),
                **_describe([np.unique(g) for g in grams]),
            }
        )


#: What classes need of each text beside its fingerprint: the size and digests of its set.
_DESCRIBED = "n int, s1 long, s2 long"


def _describe(sets: list[np.ndarray]) -> dict[str, object]:
    digests = np.array([jaccard_join.digest(s) for s in sets], np.int64).reshape(-1, 2)
    return {"n": [len(s) for s in sets], "s1": digests[:, 0], "s2": digests[:, 1]}


def bands_of(fingerprint: str) -> Column:
    """A hash of each band of a fingerprint in bytes: ``BAND_ROWS`` places with their number. Bands that agree in whole signatures agree here."""
    size = BAND_ROWS * BITS // 8
    return F.array(*[F.xxhash64(F.lit(i), F.substring(fingerprint, i * size + 1, size)) for i in range(PERMUTATIONS // BAND_ROWS)])


def similar_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = SIMILAR_PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``class_id`` (the least id reachable by verified links, null last) of every row.

    A text without words is alone. Rows of one id are judged each by its own text; repeated rows stay. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "fingerprints")
    own = jaccard_join.identified(docs, doc, text)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            for a, b in blocks(texts):
                sets = [np.unique(s) for s in shingle_lists(texts[a:b], SHINGLE)]
                made = {"fingerprint": to_bytes(codes(signatures(sets)))} | _describe(sets)
                yield pd.DataFrame({c: pdf[c].iloc[a:b].to_numpy() for c in ("doc", "no", "t")} | made)

    described = own.mapInPandas(describe, f"doc long, no boolean, t long, fingerprint binary, {_DESCRIBED}")
    return _classes(own, scratch.write(jaccard_join.with_ids(described), "wide"), percent, scratch)


def _classes(own: DataFrame, wide: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``similar_classes`` from the table ``wide``: ``doc``, ``t``, and what is described of each text."""
    by = ["s1", "s2", "n"]
    banded = jaccard_join.number_classes(wide.select("doc", "t", *by, "fingerprint"), by, scratch, F.first("fingerprint").alias("fingerprint"))
    classes = scratch.write(banded.drop("fingerprint"), "narrow")
    # Most bands are those of one class: only their hashes are counted, and the others meet what is left.
    each = banded.select("rep", "n", F.explode(bands_of("fingerprint")).alias("band"))
    held = scratch.write(each.groupBy("band").count().where("count > 1"), "held")
    few = held.count() <= jaccard_join.MAX_SPREAD_IDS
    bands = scratch.write(each.join(F.broadcast(held) if few else held, "band"), "bands")
    scratch.drop("held", "classes")
    left = bands.where(F.col("count") <= jaccard_join.HOT)
    right = left.select("band", F.col("rep").alias("b"), F.col("n").alias("m"))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("rep") < F.col("b"))
    pairs = scratch.write(left.join(right, "band").where(fits).select(F.col("rep").alias("a"), "b").distinct(), "pairs")
    crowded = scratch.write(bands.where(F.col("count") > jaccard_join.HOT).select(F.col("band").alias("key"), "rep", "n"), "blocks")
    scratch.drop("bands")
    asked = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(crowded.select("rep"))
    sets = jaccard_join.class_sets(own, classes, asked, SHINGLE, scratch)
    edges = jaccard_join.verified(pairs, sets, percent).unionByName(jaccard_join._block_edges(crowded, sets, percent, scratch))
    found = jaccard_join.component_ids(edges, classes, scratch)
    scratch.drop("pairs", "blocks", "wanted", "sets", "sets_once", *jaccard_join.BLOCK_TABLES)
    back = wide.select("doc", "t", *by).join(classes.select(*by, "rep", "least"), by, "left").join(found, "rep", "left")
    class_id = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.coalesce("least", "doc"))
    return back.select(F.col("doc").alias("doc_id"), F.col("t").alias("text_hash"), class_id.alias("class_id"))


def fingerprint_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``edited_likeness`` with ``class_id`` of ``similar_classes`` for each row.

    Only rows that aren't the first of their class are listed for the join: a broadcast up to a checked number, a shuffle beyond.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    own = jaccard_join.identified(docs, doc, text)
    wide = scratch.write(_compared(own), "wide")
    found = _classes(own, wide, SIMILAR_PERCENT, scratch).where(~F.col("class_id").eqNullSafe(F.col("doc_id"))).distinct()
    key = lambda c: [F.coalesce(c, F.lit(0)).alias("d"), F.col(c).isNull().alias("none")]
    found = scratch.write(found.select(*key("doc_id"), F.col("text_hash").alias("t"), "class_id"), "linked")
    scratch.drop("narrow", "numbers")
    rows = wide.drop("n", "s1", "s2").select("*", *key("doc"))
    rows = rows.join(F.broadcast(found) if found.count() <= jaccard_join.MAX_SPREAD_IDS else found, ["d", "none", "t"], "left")
    return _results(rows, F.coalesce("class_id", "doc").alias("class_id"))

"""Exact Jaccard join of word n-gram sets, by a grouped prefix join, down to connected components.

Sets that link share one of the first ``n - ceil(t n) + 1`` elements in any order of elements that all sets follow. The order
here is by frequency (powers of two), then by hash, so prefixes hold a text's rarest elements.

1. Elements are counted over all documents, packed into ranges of hashes; those found more than once go to a table of
   fixed size, with their level, the logarithm of the count, and the table is spread to the workers. If there are more than
   ``MAX_KNOWN``, the least level kept is raised until they fit, and what is below counts as rare. The order only affects cost.
2. Equal sets become one class. Classes are numbered in the order of their least id (null last), so numbers are unlike whatever
   the ids are, and the least number of a component leads to its least id. Classes with the same prefix and size become one group.
3. Groups that share an element of their prefixes are paired, those of unlike size filtered out, group pairs made distinct.
4. Group pairs and groups are expanded to members, and members are verified with their whole sets.
   An element (or a group, or a group pair) with more than ``HOT`` members is a block instead, whatever its level in the
   table: no pair of its members is emitted (see ``_block_edges``).
5. Links go through connected components; a document has its class's component.

With ``count_links`` blocks give all their links, linked parts or not. Links of classes are made distinct, and a row's links are
the rows of its class but itself and those of all classes linked with it. Traffic then grows with the links between classes.

Nothing is capped or sampled. Ranges follow the number of elements, so a task's share is bounded. Sets are hashes of 64 bits, so
sizes and overlaps are exact but for collisions within one pair of documents.

Defined results: without words or text the set is empty, size 0, linked with nothing (its own component). A null id is
greater than all others; its component is null if no other id is in it. Rows with the same id are judged each by its own
text. Repeated rows stay. Other columns are ignored, whatever their names. An empty table gives no rows. Any long is an id. A
very long text is one set in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.scratch import Scratch
from tidemark.llm.words import blocks, mix, shingle_lists

#: An element in more sets is frequent: its prefixes are blocks, unless few of them hold it.
HOT = 32
#: Elements whose level is spread, and bits of the table that is spread for them: one byte for each of its places.
MAX_KNOWN, TABLE_BITS = 4_000_000, 25
#: Elements that a worker counts before it sends what it has.
COUNT_CHUNK = 2_000_000
#: Bytes of text whose elements are counted in one range, and prefix elements that are paired in one.
RANGE_BYTES, RANGE_ELEMENTS = 1 << 24, 1_000_000
#: Elements and sets in one chunk of a block, and sets that it may hold however large they are.
CHUNK_ELEMENTS, CHUNK_ROWS, LEAST_ROWS = 2_000_000, 2048, 32
#: Rows of ids or class numbers that may be spread to all executors; above this, documents are joined with them by a shuffle.
MAX_SPREAD_IDS = 1_000_000
#: Tables of ``_block_edges``.
BLOCK_TABLES = ("parts", "tops", "merged", "counted", "homes")
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of size n one of which every linked, different set has; 0 if only an equal set can be linked."""
    return n - -(-n * percent // 100) + 1 if n * (100 - percent) >= percent else 0


def linked(overlap, n_a, n_b, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digest(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set of hashes, whatever its order."""
    with np.errstate(over="ignore"):
        a, b = mix(x).sum(dtype=np.uint64), mix(x ^ _SECOND).sum(dtype=np.uint64)
    return int(np.int64(a)) if a < 2**63 else int(a) - 2**64, int(b) if b < 2**63 else int(b) - 2**64


def _sets(texts: list, words: int) -> Iterator[np.ndarray]:
    for a, b in blocks(texts):
        for s in shingle_lists(texts[a:b], words):
            yield np.unique(s)


def _levels(docs: DataFrame, words: int, ranges: int, scratch: Scratch) -> np.ndarray:
    """Levels of repeated elements by the first bits of their hashes (the greatest of those that meet in a place).

    Counted over all documents. The level in the table is what orders an element, so meeting costs time at most.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            out = []
            for kind in (0, 1):  # elements seen once need no count
                mine = codes[counts == 1] if kind == 0 else codes[counts > 1]
                number = counts[counts > 1].astype(np.uint32)
                edges = np.searchsorted(mine, (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
                for r in range(ranges):
                    a, b = edges[r], edges[r + 1]
                    if b > a:
                        out.append((r, mine[a:b].tobytes(), number[a:b].tobytes() if kind else b""))
            return pd.DataFrame(out, columns=["r", "codes", "counts"])

        for pdf in batches:
            for s in _sets(list(pdf["text"]), words):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
                if size >= COUNT_CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["codes"]])
        each = np.concatenate([np.frombuffer(n, np.uint32) if n else np.ones(len(c) // 4, np.uint32) for c, n in zip(pdf["codes"], pdf["counts"], strict=True)])
        order = np.argsort(codes, kind="stable")
        codes, each = codes[order], each[order]
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        total = np.add.reduceat(each.astype(np.int64), at)
        level = np.floor(np.log2(total)).astype(np.uint8)
        mine = level > 0
        sizes = np.bincount(level[mine], minlength=64).tolist()
        return pd.DataFrame({"r": pdf["r"].iloc[:1], "codes": [codes[at][mine].tobytes()], "level": [level[mine].tobytes()], "sizes": [sizes]})

    packed = docs.select("text").mapInPandas(pack, "r int, codes binary, counts binary")
    known = scratch.write(packed.groupBy("r").applyInPandas(count, "r int, codes binary, level binary, sizes array<long>"), "levels")  # RANGE_BYTES of text each
    sizes = np.sum([r["sizes"] for r in known.select("sizes").collect()] or [[0] * 64], axis=0)  # a row of 64 numbers for each range
    least = next(k for k in range(1, 65) if sizes[k:].sum() <= MAX_KNOWN)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, c, v in zip(pdf["r"], pdf["codes"], pdf["level"], strict=True):
                keep = np.frombuffer(v, np.uint8) >= least
                rows.append((r, np.frombuffer(c, np.uint32)[keep].tobytes(), np.frombuffer(v, np.uint8)[keep].tobytes()))
            yield pd.DataFrame(rows, columns=["r", "codes", "level"])

    table = np.zeros(1 << TABLE_BITS, np.uint8)
    for r in known.select("r", "codes", "level").mapInPandas(cut, "r int, codes binary, level binary").collect():  # MAX_KNOWN elements
        place, level = np.frombuffer(r["codes"], np.uint32) >> (32 - TABLE_BITS), np.frombuffer(r["level"], np.uint8)
        np.maximum.at(table, place, level)
    return table


def _described(docs: DataFrame, words: int, percent: int, spread) -> DataFrame:
    """A row for each document: size, digests of set and prefix, the prefix and how many of it are not frequent."""
    hot_level = int(np.log2(HOT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = spread.value
        for pdf in batches:
            rows = []
            for d, no, t, s in zip(pdf["doc"], pdf["no"], pdf["t"], _sets(list(pdf["text"]), words), strict=True):
                n = len(s)
                p = prefix_length(n, percent)
                prefix, cold = s[:0], 0
                if p:
                    level = table[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                    first = np.argsort(level, kind="stable")[:p]  # of one level, by hash
                    prefix, cold = s[first], int((level[first] < hot_level).sum())
                rows.append((d, no, t, n, *digest(s), *digest(prefix), cold, prefix.tobytes()))
            yield pd.DataFrame(rows, columns=["doc", "no", "t", "n", "s1", "s2", "p1", "p2", "cold", "prefix"])

    schema = "doc long, no boolean, t long, n int, s1 long, s2 long, p1 long, p2 long, cold int, prefix binary"
    return with_ids(docs.mapInPandas(run, schema))


def identified(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, ``no`` (whether there is no id; workers get nullable numbers as floats), ``text`` and ``t``, its hash."""
    ident, body = F.col(doc).cast("long"), F.col(text).cast("string")
    return docs.select(F.coalesce(ident, F.lit(0)).alias("doc"), ident.isNull().alias("no"), body.alias("text"), F.xxhash64(body).alias("t"))


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc", F.when(~F.col("no"), F.col("doc"))).drop("no")


def number_classes(described: DataFrame, by: list[str], scratch: Scratch, *more) -> DataFrame:
    """Classes of equal sets: ``rep``, a number in the order of ``least``, the least id (null last), and ``t``, the text of a row with that id."""
    least_text = F.coalesce(F.min_by("t", "doc"), F.min("t")).alias("t")
    classes = described.where("n > 0").groupBy(*by).agg(F.min("doc").alias("least"), least_text, F.count(F.lit(1)).alias("rows"), *more)
    return scratch.write(classes.orderBy(F.asc_nulls_last("least"), *by).withColumn("rep", F.monotonically_increasing_id()), "classes")


def class_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """``rep`` and ``elements``, the whole sets of the classes that are asked for; ``docs`` as of ``identified``."""
    wanted = classes.select("rep", F.coalesce("least", F.lit(0)).alias("doc"), F.col("least").isNull().alias("no"), "t").join(asked.distinct(), "rep", "left_semi")
    wanted = scratch.write(wanted, "wanted")
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= MAX_SPREAD_IDS else wanted, ["doc", "no", "t"]).select("rep", "text")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["rep"], "elements": [s.tobytes() for s in _sets(list(pdf["text"]), words)]})

    sets = scratch.write(texts.mapInPandas(whole, "rep long, elements binary"), "sets")
    if sets.groupBy("rep").count().where("count > 1").isEmpty():
        return sets
    return scratch.write(sets.dropDuplicates(["rep"]), "sets_once")  # rows that repeat


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose sets are linked."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([p, q]))
                keep.append(bool(linked(int((both[1:] == both[:-1]).sum()), len(p), len(q), percent)))
            yield pdf.loc[keep, ["a", "b"]]

    x, y = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")), sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long")


def component_ids(edges: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep``, ``component`` (the least class of its component) and ``component_id`` (that one's least id) for each class that has a link."""
    found = connected_components(edges, scratch)  # it begins by writing them
    # A component's number is that of the class with its least id.
    numbers = found.select(F.col("component").alias("rep")).distinct().join(classes.select("rep", "least"), "rep")
    numbers = scratch.write(numbers.select(F.col("rep").alias("component"), F.col("least").alias("component_id")), "numbers")
    few = numbers.count() <= MAX_SPREAD_IDS
    return found.join(F.broadcast(numbers) if few else numbers, "component").select(F.col("node").alias("rep"), "component", "component_id")


def _cold_pairs(groups: DataFrame, percent: int, ranges: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups that share an infrequent element of their prefixes, fit in size, and share enough of their prefixes.

    What is left of a set after its prefix bounds what it can share there. So with c shared elements in the prefixes, the
    overlap is at most c + max(n - p) of the two. Frequent elements aren't counted here: as many as both hold may be shared.

    Elements that the table takes for infrequent but more than ``HOT`` groups hold make no pairs. They are returned as well
    (``token``, ``leader``, ``n``), and count as frequent in the bound.
    """
    kind = [("t", "<u8"), ("g", "<i8"), ("n", "<i4"), ("f", "<i4")]
    names = ["a", "b", "n_a", "n_b", "f_a", "f_b"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [np.frombuffer(p, np.uint64)[:c] for p, c in zip(pdf["prefix"], pdf["cold"], strict=True)]
            size = np.array([len(k) for k in keys])
            if not size.sum():
                continue
            token = np.concatenate(keys)
            rec = np.empty(len(token), kind)
            rec["t"], rec["g"], rec["n"] = token, np.repeat(pdf["leader"].to_numpy(), size), np.repeat(pdf["n"].to_numpy(), size)
            rec["f"] = np.repeat([len(p) // 8 for p in pdf["prefix"]] - size, size)
            where = ((token >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(where, kind="stable")
            rec, where = rec[order], where[order]
            at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            yield pd.DataFrame({"r": where[at].astype(np.int32), "rec": [x.tobytes() for x in np.split(rec, at[1:])]})

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        rec = np.concatenate([np.frombuffer(x, kind) for x in pdf["rec"]])
        rec = rec[np.lexsort((rec["g"], rec["n"], rec["t"]))]
        at = np.flatnonzero(np.concatenate([[True], rec["t"][1:] != rec["t"][:-1]]))
        held = np.repeat(np.diff(np.concatenate([at, [len(rec)]])), np.diff(np.concatenate([at, [len(rec)]])))
        big, rec = rec[held > HOT], rec[(held > 1) & (held <= HOT)]
        found, k = [], 1
        while k < len(rec):  # ends after the longest run: HOT
            same = rec["t"][k:] == rec["t"][:-k]
            if not same.any():
                break
            fits = same & (100 * rec["n"][:-k].astype(np.int64) >= percent * rec["n"][k:].astype(np.int64))
            found.append(np.stack([rec[c][:-k][fits] if i == 0 else rec[c][k:][fits] for c in ("g", "n", "f") for i in (0, 1)]))
            k += 1
        both = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
        swap = both[0] > both[1]
        both[:, swap] = both[[1, 0, 3, 2, 5, 4]][:, swap]
        both, shared = np.unique(both, axis=1, return_counts=True)
        zero = np.zeros(len(big), np.int64)
        many = [big["t"].view(np.int64), big["g"], big["n"].astype(np.int64), zero, zero, zero]
        out = {c: np.concatenate([x, y]) for c, x, y in zip(names, both, many, strict=True)}
        return pd.DataFrame(out | {"shared": np.concatenate([shared, zero])})

    packed = groups.where("cold > 0").select("leader", "n", "cold", "prefix").mapInPandas(pack, "r int, rec binary")
    some = packed.groupBy("r").applyInPandas(pair, ", ".join(f"{c} long" for c in [*names, "shared"]))  # RANGE_ELEMENTS each
    some = scratch.write(some, "cold")
    big = some.where("shared = 0").select(F.col("a").alias("token"), F.col("b").alias("leader"), F.col("n_a").cast("int").alias("n"))
    shared = some.where("shared > 0").groupBy(*names).agg(F.sum("shared").alias("shared"))
    if not big.isEmpty():
        own = scratch.write(big.groupBy("leader").agg(F.count(F.lit(1)).alias("more")), "more")
        for x in ("a", "b"):
            more = own.select(F.col("leader").alias(x), "more")
            shared = shared.join(more, x, "left").withColumn(f"f_{x}", F.col(f"f_{x}") + F.coalesce("more", F.lit(0))).drop("more")
    behind = lambda n: F.ceil(n * percent / 100.0) - 1  # elements after the prefix
    most = F.col("shared") + F.least("f_a", "f_b") + F.greatest(behind(F.col("n_a")), behind(F.col("n_b")))
    return shared.where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), big


def _hot_rows(groups: DataFrame) -> DataFrame:
    """Elements of prefixes that are frequent: ``token``, ``leader``, ``n``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [np.frombuffer(p, np.int64)[c:] for p, c in zip(pdf["prefix"], pdf["cold"], strict=True)]
            size = [len(k) for k in keys]
            yield pd.DataFrame({"token": np.concatenate(keys), "leader": np.repeat(pdf["leader"].to_numpy(), size), "n": np.repeat(pdf["n"].to_numpy(), size)})

    return groups.where("length(prefix) > 8 * cold").select("leader", "n", "cold", "prefix").mapInPandas(run, "token long, leader long, n int")


def link_parts(reps: np.ndarray, sets: list[np.ndarray], percent: int, part: np.ndarray | None = None, every: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links among sets, and a number of the part that each set is in then.

    ``part``: parts that are connected already. The links are ``every`` one, or as few as connect what all links connect.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    reps, sets, size = reps[order], [sets[i] for i in order], size[order]
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    part = np.arange(len(sets)) if part is None else part[order]
    flag = np.zeros(len(vocabulary), np.int64)
    out = []
    last = np.searchsorted(size, size * 100 // percent, side="right")
    for a in range(len(sets)):
        others = np.flatnonzero(part[a + 1 : last[a]] != part[a]) + a + 1 if not every else np.arange(a + 1, last[a])
        if not len(others):
            continue
        own = codes[starts[a] : starts[a] + size[a]]
        flag[own] = 1
        if 2 * len(others) > last[a] - a:
            lo, hi = others[0], others[-1] + 1
            overlap = np.add.reduceat(flag[codes[starts[lo] : starts[hi - 1] + size[hi - 1]]], starts[lo:hi] - starts[lo])[others - lo]
        else:
            overlap = np.array([flag[codes[starts[b] : starts[b] + size[b]]].sum() for b in others])
        flag[own] = 0
        for b in others[linked(overlap, size[a], size[others], percent)]:
            if every or part[b] != part[a]:
                out.append((int(reps[a]), int(reps[b])))
                part[part == part[b]] = part[a]
    back = np.empty(len(sets), part.dtype)
    back[order] = part
    return out, back


def block_links(reps: np.ndarray, sets: list[np.ndarray], percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links among sets: ``every`` one, or as few as connect what all links connect."""
    return link_parts(reps, sets, percent, every=every)[0]


def _block_edges(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, every: bool = False) -> DataFrame:
    """Links ``a``, ``b`` of the blocks in ``members`` (``key``, ``rep``, ``n``), by their ``sets`` (``rep``, ``elements``).

    A block is split into bands of size, since sets of unlike size can't link, and each band is dealt to chunks.

    1. In each chunk sets are connected. What is connected is a part from then on, with a leader.
    2. The leaders of a band's chunks are connected, if they fit into one chunk.
    3. Only sets of different parts are left to be compared. A part of more than a chunk is dealt to pieces; smaller
       parts are dealt to pieces together. Each two pieces meet in one task, but those of the same large part. So a group of many
       copies of a text, which is one part by now, costs nothing more, and its rows meet only what is foreign to it.

    With ``every`` link the first two steps are left out, and each set is a part of its own.
    """
    band = F.floor(F.log2("n")).cast("int")
    lower = F.ceil(F.col("n") * percent / 100.0) < F.call_function("shiftleft", F.lit(1), band)  # can link with a set of the band below
    members = members.withColumn("band", F.explode(F.when(lower, F.array(band, band - 1)).otherwise(F.array(band)))).select("key", "band", "rep")
    most = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(CHUNK_ROWS), F.floor(F.lit(CHUNK_ELEMENTS) / F.call_function("shiftleft", F.lit(1), F.col("band") + 1)))).cast("int")
    sizes = members.groupBy("key", "band").count().where("count > 1").select("key", "band", F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    dealt = members.join(sizes, ["key", "band"])
    sets_of = lambda pdf: [np.frombuffer(e, np.uint64) for e in pdf["elements"]]

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = pdf["rep"].to_numpy()
        _, part = link_parts(reps, sets_of(pdf), percent)
        leader = pd.Series(reps).groupby(part).transform("min").to_numpy()
        return pdf[["key", "band", "rep"]].assign(part=leader, chunks=pdf["chunks"].iloc[0])

    schema = "key long, band int, rep long, part long, chunks int"
    if every:
        parts, edges = dealt.withColumn("part", F.col("rep")), []
    else:
        first = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).join(sets, "rep")
        parts = scratch.write(first.groupBy("key", "band", "chunk").applyInPandas(connect, schema), "parts")
        edges = [parts.where("rep <> part").select(F.col("rep").alias("a"), F.col("part").alias("b"))]
        parts = parts.where("chunks > 1")  # one chunk is all there is
        if parts.isEmpty():
            return edges[0]
        leaders = parts.select("key", "band", "part", "chunks").distinct()
        few = leaders.groupBy("key", "band").count().where(F.col("count").between(2, most)).select("key", "band")
        leaders = leaders.join(few, ["key", "band"]).withColumnRenamed("part", "rep").join(sets, "rep")
        tops = scratch.write(leaders.groupBy("key", "band").applyInPandas(connect, schema), "tops")
        edges.append(tops.where("rep <> part").select(F.col("rep").alias("a"), F.col("part").alias("b")))
        tops = tops.select("key", "band", F.col("rep").alias("part"), F.col("part").alias("top"))
        parts = parts.join(tops, ["key", "band", "part"], "left").withColumn("part", F.coalesce("top", "part")).drop("top")
        parts = scratch.write(parts, "merged")

    counted = scratch.write(parts.groupBy("key", "band", "part").agg(F.count(F.lit(1)).alias("rows")), "counted")
    left = counted.groupBy("key", "band").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("rows") <= most, F.col("rows"))).alias("small"))
    left = left.where("parts > 1").drop("parts")
    # A piece has a negative number if it holds small parts, else that of its part.
    home = F.when(F.col("rows") > most, F.col("part")).otherwise(-1 - F.pmod(F.xxhash64("part"), F.ceil(F.col("small") / most)))
    homes = scratch.write(counted.join(left, ["key", "band"]).select("key", "band", "part", "rows", home.alias("home")), "homes")
    each = homes.groupBy("key", "band", "home").agg(F.when(F.col("home") < 0, 1).otherwise(F.ceil(F.sum("rows") / F.first(most))).cast("int").alias("pieces"))
    one, two = (each.select("key", "band", F.col("home").alias(f"home_{x}"), F.sequence(F.lit(0), F.col("pieces") - 1).alias(f"p_{x}")) for x in "ij")
    meet = one.join(two, ["key", "band"]).where("home_i < home_j or (home_i = home_j and home_i < 0)")
    meet = meet.withColumn("p_i", F.explode("p_i")).withColumn("p_j", F.explode("p_j"))
    rows = parts.join(homes, ["key", "band", "part"]).join(each, ["key", "band", "home"])
    rows = rows.select("key", "band", "rep", "part", "home", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int").alias("piece"))
    at = lambda x: rows.withColumnsRenamed({"home": f"home_{x}", "piece": f"p_{x}"}).join(meet, ["key", "band", f"home_{x}", f"p_{x}"])
    task = ["key", "band", "home_i", "p_i", "home_j", "p_j"]
    both = at("i").select(*task, "rep", "part").unionByName(at("j").where("home_i <> home_j").select(*task, "rep", "part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.unique(pdf["part"].to_numpy(), return_inverse=True)[1]
        found, _ = link_parts(pdf["rep"].to_numpy(), sets_of(pdf), percent, part, every)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    crossing = both.join(sets, "rep").groupBy(*task).applyInPandas(compare, "a long, b long")
    for e in edges:
        crossing = crossing.unionByName(e)
    return crossing


def components(docs: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links), ``text_hash`` and ``representative`` for every row of ``docs``.

    One id and text represent each component: the least id, and of its texts there that of the first class. Rows without words represent themselves.

    With ``count_links`` also ``n_links``: how many other rows are linked with the row.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    least_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = identified(docs, doc, text)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = spark.sparkContext.broadcast(_levels(own, words, max(least_ranges, size // RANGE_BYTES), scratch))
    described = scratch.write(_described(own, words, percent, spread), "described")
    spread.destroy()  # what was made with it is in a table
    scratch.drop("levels")

    key, by = ["p1", "p2", "n"], ["s1", "s2"]
    classes = number_classes(described, [*by, *key], scratch)
    leaders = classes.groupBy(*key).agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members"))
    prefixes = described.where("length(prefix) > 0").groupBy(*key).agg(F.first("prefix").alias("prefix"), F.first("cold").alias("cold"))
    groups = scratch.write(prefixes.join(leaders, key), "groups")
    named = groups.where("members > 1").select(*key, "leader", "members")  # groups of more than one class
    many = scratch.write(classes.join(named, key).select("leader", "rep", "n", "members"), "members")

    # Group pairs from infrequent elements, and from frequent ones that few prefixes hold.
    cold = groups.agg(F.sum("cold")).first()[0] or 0
    found, big = _cold_pairs(groups, percent, int(max(least_ranges, cold // RANGE_ELEMENTS)), scratch)
    hot = scratch.write(_hot_rows(groups).unionByName(big), "hot")
    held = hot.groupBy("token").count().where("count > 1")
    few, more = held.where(F.col("count") <= HOT).select("token"), held.where(F.col("count") > HOT).select("token")
    left = hot.join(few, "token")
    right = left.select("token", F.col("leader").alias("b"), F.col("n").alias("m"))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("leader") < F.col("b"))
    rare = left.join(right, "token").where(fits).select(F.col("leader").alias("a"), "b")
    group_pairs = scratch.write(found.unionByName(rare).distinct(), "group_pairs")

    # Expansion to members: a group of one class is its leader.
    alone = lambda g: many.select(F.col("leader").alias(g), F.col("rep").alias(f"{g}_rep"), F.col("members").alias(f"{g}_members"))
    wide_pairs = group_pairs.join(alone("a").select("a", "a_members").distinct(), "a", "left").join(alone("b").select("b", "b_members").distinct(), "b", "left")
    wide_pairs = wide_pairs.na.fill(1, ["a_members", "b_members"])
    little = wide_pairs.where(F.col("a_members") * F.col("b_members") <= HOT).select("a", "b")
    large = wide_pairs.where(F.col("a_members") * F.col("b_members") > HOT).select("a", "b")
    pairs = little.join(alone("a"), "a", "left").join(alone("b"), "b", "left").select(F.coalesce("a_rep", "a").alias("a"), F.coalesce("b_rep", "b").alias("b"))
    inside = many.where(F.col("members") <= HOT)
    mates = inside.select("leader", F.col("rep").alias("b"))
    pairs = scratch.write(pairs.unionByName(inside.join(mates, "leader").where("rep < b").select(F.col("rep").alias("a"), "b")), "pairs")

    # Blocks: frequent elements, large groups, and group pairs with large members.
    of_group = many.select("leader", F.col("rep").alias("member"))
    members = hot.join(more, "token").join(of_group, "leader", "left").select(F.col("token").alias("key"), F.coalesce("member", "leader").alias("rep"), "n")
    members = members.unionByName(many.where(F.col("members") > HOT).select(F.xxhash64("leader").alias("key"), "rep", "n"))
    ends = large.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("leader"))
    ends = ends.join(groups.select("leader", "n"), "leader").join(of_group, "leader", "left").select("key", F.coalesce("member", "leader").alias("rep"), "n")
    members = scratch.write(members.unionByName(ends), "blocks")

    # The whole sets of all that is to be verified.
    asked = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(members.select("rep"))
    sets = class_sets(own, classes, asked, words, scratch)
    edges = verified(pairs, sets, percent).unionByName(_block_edges(members, sets, percent, scratch, count_links))
    if count_links:
        edges = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    linked_classes = component_ids(edges, classes, scratch)
    scratch.drop("sets", "sets_once", "pairs", "blocks", "groups", "members", "hot", "cold", "more", "group_pairs", "wanted", *BLOCK_TABLES)

    back = described.select("doc", "t", "n", *by).join(classes.select(*by, "n", "rep", "least", "rows", F.col("t").alias("own_t")), [*by, "n"], "left").join(linked_classes, "rep", "left")
    counts = []
    if count_links:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        far = sides.join(classes.select(F.col("rep").alias("b"), F.col("rows").alias("away")), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("away").alias("far"))
        back = back.join(far, "rep", "left")
        counts = [F.coalesce(F.col("rows") - 1 + F.coalesce("far", F.lit(0)), F.lit(0)).alias("n_links")]
    return back.select(
        F.col("doc").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.coalesce("least", "doc")).alias("component_id"),
        F.col("t").alias("text_hash"),
        (F.col("rep").isNull() | ((F.coalesce("component", "rep") == F.col("rep")) & F.col("doc").eqNullSafe(F.col("least")) & (F.col("t") == F.col("own_t")))).alias("representative"),
        *counts,
    )


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

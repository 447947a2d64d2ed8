"""Nothing is capped: networks, repetitions, populations, equal rows; and the registered queries do what their operators are tested for."""

import collections
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_llm import taken_of_sources
from tidemark.llm import line_dedup, mixing, queries, sharding, url_filter
from tidemark.llm.scratch import Scratch


def test_costs_of_repetitions_rise_without_end():
    """Up to 64 one by one, then by doublings; all tokens are offered."""
    assert mixing._offers(10, 95) == [10] * 9 + [5] and mixing._offers(0, 7) == [7] and mixing._offers(5, 0) == []
    many = mixing._offers(1, 10_000)
    assert many[:65] == [1] * 65 and many[65:70] == [2, 4, 8, 16, 32] and sum(many) == 10_000 and len(many) < 80


def test_texts_in_five_sources_cost_by_each_repetition():
    """Fifteen repetitions, each dearer than the one before: against the cheapest flow one token at a time."""
    rng = random.Random(2)
    for _ in range(20):
        members = [rng.sample(range(5), rng.choice([1, 2, 5, 5])) for _ in range(4)]
        once = [rng.randint(1, 3) for _ in members]
        offers = [mixing._offers(n, 3 * n * len(m)) for n, m in zip(once, members, strict=True)]
        reach = [dict.fromkeys(m, 3 * n) for n, m in zip(once, members, strict=True)]
        quota = [rng.randint(0, 12) for _ in range(5)]
        flow = mixing.min_cost_flow(offers, reach, quota)
        used = [sum(v for (p, _), v in flow.items() if p == q) for q in range(4)]
        cost = lambda p, n: sum(sorted(r for r, k in enumerate(offers[p]) for _ in range(k))[:n])  # noqa: B023, E731
        assert (sum(flow.values()), sum(cost(p, u) for p, u in enumerate(used))) == brute.cheapest_flow(offers, reach, quota)


@pytest.mark.parametrize("arcs", [160_000, 3000, 40, 1])
def test_all_patterns_of_many_sources(spark, arcs, monkeypatch):
    """Ten sources, all 1,023 patterns: quotas are met also where texts are offered to some of their sources only."""
    monkeypatch.setattr(mixing, "MAX_ARCS", arcs)
    rng, rows, t = random.Random(5), [], 0
    for k in range(1, 11):
        for m in itertools.combinations("abcdefghij", k):
            size, t = rng.randint(1, 40), t + 1
            rows += [(t, s, size) for s in m]
    rows += [(t + i, s, 25) for i, s in enumerate("abcdefghij" * 30, 1)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, t long, source string, size long").repartition(3)
    got = mixing.mix(df, F.col("source"), F.col("t"), ["doc_id"], F.col("size")).collect()
    target, taken = taken_of_sources([r[2:] for r in rows], [(r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got])
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in target), (target, taken)


def test_mix_is_the_same_whatever_is_spread(spark, monkeypatch):
    """No size of the network switches to another law: rows are taken alike with any limit of what is spread."""
    rng = random.Random(8)
    rows = [(t, s, rng.randint(1, 40)) for t in range(150) for s in rng.sample("abcdef", rng.randint(1, 5))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, t long, source string, size long").repartition(3)
    got = []
    for arcs in (160_000, 20, 1):
        monkeypatch.setattr(mixing, "MAX_ARCS", arcs)
        got.append(sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(df, F.col("source"), F.col("t"), ["doc_id"], F.col("size")).collect()))
    assert got[0] == got[1] == got[2]


def test_levels_are_the_offers_of_all_patterns():
    once, most = [10, 0, 5, 1, 3], [95, 7, 0, 10_000, 3]
    levels = list(zip(*mixing._levels(np.array(once), np.array(most)), strict=True))
    assert [[int(x) for x in level if x] for level in levels] == [mixing._offers(*x) for x in zip(once, most, strict=True)]


def test_steps_reach_the_tolerance():
    assert url_filter.most_steps(0.5, 1e-9) <= 40 < url_filter.most_steps(0.85, 1e-9) < url_filter.most_steps(0.99, 1e-9)
    for damping, tolerance in ((1.0, 1e-9), (0.0, 1e-9), (0.5, 0.0)):
        with pytest.raises(ValueError):
            url_filter.most_steps(damping, tolerance)


#: The contract's words, written out here, so that the operator's own list is not compared with itself.
CONTRACT = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
RULED = [
    ("com/en/1", 0), ("a.com/en/", 0), ("example.com/en/6", 0), ("example.com/en/71", 1), ("b.EXAMPLE.com/en/7", 1), ("net/de/", 2), ("a.net/de/8", 2), ("example.net/de/7", 2),
    ("example.net/de/8", 3), ("b.example.net/de/81?x", 3), ("org/es/", 4), ("a.org/es/1#t", 4), ("example.info/de/8", None),
]


def test_rules_are_those_of_the_contract(spark, tmp_path):
    """Query and SQL, on pages of which every rule fits some."""
    assert [(r.name, r.verdict) for r in url_filter.RULES] == CONTRACT
    pages = spark.createDataFrame([(i, f"https://{u}", "<a>") for i, (u, _) in enumerate(RULED)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = [(i, *(CONTRACT[k] if k is not None else (None, "allow"))) for i, (_, k) in enumerate(RULED)]
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(db.execute(f"SELECT page_id, rule, verdict FROM ({queries.ORACLES['op3_url_filter']})").fetchall()) == want


# Line dedup.


def test_each_line_is_written_once_a_level(spark, monkeypatch):
    """Four batches: their tables are the runs of level 0, so what is written is the lines, four batches, one merge and what is dropped."""
    made, write, bucketed = [], Scratch.write, Scratch.write_bucketed
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *a, **k: (made.append(name), write(self, df, name, *a, **k))[1])
    monkeypatch.setattr(Scratch, "write_bucketed", lambda self, df, name, *a: (made.append(name), bucketed(self, df, name, *a))[1])
    saved, save = [], DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, name, *a, **k: (saved.append(name), save(self, name, *a, **k))[1])
    rows = [(i, f"a line that all have\nline of the pair {i // 2}\nline of every tenth {i % 10}\nonly here {i}") for i in range(100)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=4)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == [(i, *x) for i, x in enumerate(brute.line_dedup(rows))]
    assert len(saved) == 4 and len(made) == 7 and "keys" not in made, (saved, made)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_run")]


# Sharding.


def chi_square(counts, expected):
    """Standard deviations by which the statistic is off its mean."""
    at = expected > 8
    x = ((counts[at] - expected[at]) ** 2 / expected[at]).sum()
    return (x - at.sum() + 1) / (2 * (at.sum() - 1)) ** 0.5


@pytest.mark.parametrize("good,bad,draws", [(500, 1500, 300), (1500, 500, 1900), (40, 5000, 20), (5000, 40, 5030), (300, 200_000, 400), (200_000, 300, 199_000), (50_000, 60_000, 50_000), (64, 64, 33), (100, 0, 50)])
def test_draws_from_large_populations(good, bad, draws, monkeypatch):
    """The way of drawing from what is too large for numpy, on numbers that it can draw as well."""
    rng, n = np.random.default_rng(good), 60_000
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    mine = sharding.hypergeometric(np.full(n, good), np.full(n, bad), np.full(n, draws), rng)
    low, high = max(0, draws - bad), min(good, draws)
    assert low <= mine.min() and mine.max() <= high
    k = np.arange(low, high + 1)
    step = np.log((good - k[:-1]) * (draws - k[:-1]) / ((k[:-1] + 1.0) * (bad - draws + k[:-1] + 1))) if len(k) > 1 else np.zeros(0)
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log_p - log_p.max())
    assert len(k) == 1 or abs(chi_square(np.bincount(mine - low, minlength=len(k)), n * p / p.sum())) < 5


def test_matrix_of_many_rows():
    rows = np.full(4096, 10**11 // 4096) + np.arange(4096) % 5
    m = sharding.draw_matrix(rows, 24, 1)
    assert (m.sum(axis=1) == rows).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and m.min() > 0
    deviation = (rows[0] / 24 * 23 / 24) ** 0.5
    assert abs((m - rows[:, None] / 24).std() / deviation - 1) < 0.02


def test_equal_rows_are_spread(spark, monkeypatch):
    """A third of all rows are one row: they go through many buckets, and shards are as exact as ever."""
    monkeypatch.setattr(sharding, "HOT_ROWS", 500)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise("own").alias("text"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    told = sharding._spread_equal(df, ["doc_id"], 17, sharding.Scratch(spark, "t"))
    hot = told.where("doc_id = -1")
    assert hot.count() == 20_000 == hot.select("_sh_i").distinct().count() and told.count() == 60_000
    largest = hot.groupBy(F.pmod(F.xxhash64("doc_id", "_sh_e", "_sh_i"), F.lit(64))).count().agg(F.max("count")).first()[0]
    assert largest < 500
    got = sharding.shard_rows(df, ["doc_id"], shards=6, buckets=64)
    assert sorted(got.columns) == ["doc_id", "m", "shard", "slot", "text"]
    rows = got.select("doc_id", "text", "shard", "slot").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 60_000 and all(sorted(v) == list(range(10_000)) for v in by.values()) and len(by) == 6
    assert collections.Counter(r["text"] for r in rows) == {"copy": 20_000, "own": 40_000} and len({r["doc_id"] for r in rows}) == 40_001
    # The copies are spread evenly over shards and slots.
    cells = np.zeros((6, 20))
    for r in rows:
        if r["text"] == "copy":
            cells[r["shard"], r["slot"] * 20 // 10_000] += 1
    assert abs(chi_square(cells.ravel(), np.full(120, 20_000 / 120))) < 5
    again = sharding.shard_rows(df.repartition(5), ["doc_id"], shards=6, buckets=64).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(again) == sorted(rows)


def test_slots_are_uniform(spark):
    """Where a row ends says nothing of where it was: neighbours by id are spread over shards and slots."""
    got = sharding.shard_rows(spark.range(24_000).withColumnRenamed("id", "doc_id"), ["doc_id"], shards=4, buckets=16).collect()
    cells = np.zeros((8, 4, 10))
    for r in got:
        cells[r["doc_id"] // 3000, r["shard"], r["slot"] // 600] += 1
    assert abs(chi_square(cells.ravel(), np.full(320, 75.0))) < 5


# The registered queries.


@pytest.fixture(scope="module")
def stored(odd, tmp_path_factory):
    at = tmp_path_factory.mktemp("stored")
    odd.write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_op6_as_registered(spark, stored, odd_rows):
    got = queries.op6_fingerprints(spark, stored).collect()
    assert len(got) == len(odd_rows)
    texts = collections.defaultdict(list)
    for r in odd_rows:
        texts[r[0]].append(r[1] or "")
    prints = collections.defaultdict(set)
    for r in got:
        mine = [t for t in texts[r["doc_id"]] if len(t) == r["n_chars"]]
        assert mine and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for t in mine if len(set(mine)) == 1 else []:
            prints[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) > 40
    # Ids that come once follow each other in descending order.
    once = sorted((d for d, v in texts.items() if d is not None and len(v) == 1), reverse=True)
    ordered = sorted((d for d in texts if d is not None), reverse=True)
    by = {r["doc_id"]: r for r in got}
    for d in once:
        after = ordered[ordered.index(d) + 1] if d != ordered[-1] else None
        if after in once:
            t, n = texts[d][0], len(texts[d][0]) // 3
            assert by[d]["edited_sha256"] == brute.sha(t[: len(t) - n] + texts[after][0][:n])


def test_op7_as_registered(spark, stored, odd_rows):
    got = queries.op7_mixing(spark, stored)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and dict(got.dtypes)["target"] == "double"
    rows = got.collect()
    assert sorted(rows, key=repr) == sorted(queries.op7_mixing(spark, stored).collect(), key=repr) and len(rows) == len(odd_rows)
    sizes = collections.defaultdict(list)
    for r in odd_rows:
        sizes[r[0]].append((r[3], len(brute.space_words(r[1]))))
    named = []
    for r in rows:
        (source,) = {s for s, n in sizes[r["doc_id"]] if n == r["size"]} if len({s for s, n in sizes[r["doc_id"]] if n == r["size"]}) == 1 else ("?",)
        named.append((source, r["size"], r["source_size"], r["target"], r["taken"]))
    taken_of_sources([(r[3], len(brute.space_words(r[1]))) for r in odd_rows], [r for r in named if r[0] != "?"])


def test_op8_as_registered(spark, stored, odd_rows):
    rows = queries.op8_sharding(spark, stored).collect()
    expected = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = collections.defaultdict(list)
    for r in rows:
        assert (r["law"], r["grown_shard"]) == ("rows", None) and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[i]) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op10_as_registered(spark, stored, odd_rows):
    rows = queries.op10_language_id(spark, stored).collect()
    held = {r["doc_id"]: r["held_out"] for r in rows}
    assert len(rows) == len(odd_rows) and all(h == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, h in held.items())
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in rows)
    texts = {r[0]: r[1] for r in odd_rows}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")) for r in rows if [x[0] for x in odd_rows].count(r["doc_id"]) == 1)


# Chat formatting.


def test_tokens_that_texts_can_spell_are_refused(tmp_path):
    import json

    from tidemark.llm import chat_format

    with open(chat_format.DEFAULT_TOKENIZER) as f:
        spec = json.load(f)
    n = max(spec["model"]["vocab"].values()) + 10
    for content, fine in (("<|own|>", True), ("</s>", False), ("[INST]", False)):
        spec["added_tokens"] = [{"id": n, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
        at = tmp_path / f"{fine}{len(content)}.json"
        at.write_text(json.dumps(spec))
        if fine:
            assert chat_format._tokenizer(str(at)).token_to_id(content) is not None
        else:
            with pytest.raises(ValueError, match="texts can spell"):
                chat_format._tokenizer(str(at))

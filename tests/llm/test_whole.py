"""Nothing is left out where many texts meet."""

import random

import pytest

from tests.llm import brute
from tidemark.llm import fingerprints, jaccard_join


@pytest.mark.parametrize("hot", [8, 32, 10_000])
def test_similar_classes_in_crowded_bands(spark, hot, monkeypatch):
    """Texts of one template: those in the middle are linked with each other, but with none of those at the ends of their bands."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng = random.Random(8)
    template = [f"w{i}" for i in range(104)]
    rows = []
    for i in range(140):
        own = 10 if 60 <= i < 80 else 40
        rows.append((i, " ".join([*template, *(f"x{rng.getrandbits(60)}" for _ in range(own))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.similar_classes(df).collect()}
    exact = {d: c for d, (_, c) in brute.components(rows, 5, 80).items()}
    assert len(set(exact.values())) == 121 and got == exact


@pytest.mark.parametrize("hot", [1, 32])
def test_jaccard_link_counts(spark, docs, doc_rows, hot, monkeypatch):
    """Also where links close circles in a block, and with rows that repeat."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 3)
    rng = random.Random(4)
    base = [f"c{i}" for i in range(60)]
    family = []
    for i in range(50):
        at = rng.randrange(60)
        family.append((1000 + i, " ".join([*base[:at], f"y{i % 45}", *base[at + 1 :]]) if i % 3 else " ".join(base), "en", "s", 1))
    rows = [(r[0], r[1]) for r in [*doc_rows, *family]]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in family], "doc_id long, text string"))
    sets = {d: brute.shingles(t, 3) for d, t in rows}
    linked = lambda x, y: x and y and 100 * len(x & y) >= 85 * len(x | y)
    expected = {a: sum(1 for b in sets if a != b and linked(sets[a], sets[b])) for a in sets}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.components(df, 3, 85, count_links=True).collect()}
    plain = brute.components(rows, 3, 85)
    assert got == {d: (*plain[d], n) for d, n in expected.items()} and max(expected.values()) > 32


@pytest.mark.parametrize("hot", [1, 32])
def test_jaccard_judges_texts_of_one_id_apart(spark, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 3)
    rng = random.Random(6)
    bases = [[f"b{k}x{i}" for i in range(60)] for k in range(6)]
    rows = [(1, " ".join(bases[0])), (5, " ".join([*bases[0][:-1], "end"])), (5, "a clean text that is like nothing else in here")]
    for _ in range(80):  # few ids: most have several texts
        base = bases[rng.randrange(6)]
        at = rng.randrange(60)
        rows.append((rng.randrange(10, 40), " ".join([*base[:at], f"z{rng.randrange(4)}", *base[at + 1 :]])))
    rows = sorted(set(rows))
    plain = brute.components(list(enumerate(t for _, t in rows)), 3, 85)
    least = {}
    for i, (_, c) in plain.items():
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {(r[0], r[1]): r[2] for r in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    got = sorted((r["doc_id"], r["text_hash"], r["component_id"]) for r in jaccard_join.components(df, 3, 85).collect())
    assert got == sorted((d, hashes[d, t], least[plain[i][1]]) for i, (d, t) in enumerate(rows))


def test_pipeline_keeps_a_clean_text_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (5, " ".join([*base[:-1], "end"])), (5, "a clean text that is like nothing else in here")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(tuple(r) for r in kept) == [rows[0], rows[2]]


def test_pipeline_keeps_texts_where_no_language_is_known(spark, tmp_path):
    import corpus_pipeline

    texts = ["some words of a clean document", "Straße", "123 !!!", "", None, "\u6f22\u5b57"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, str(tmp_path)).collect()) == [0, 1, 5]


@pytest.mark.parametrize(("least", "rows"), [(4, 4), (4, 9), (32, 2048)])
def test_blocks_of_many_chunks(spark, least, rows, monkeypatch):
    """Families of one template, close and not so close, and sets in between: parts that need every step of a block."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "LEAST_ROWS", least)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", rows)
    rng = random.Random(12)
    template = [f"w{i}" for i in range(80)]
    family = [(i, " ".join([*template, *(f"x{rng.randrange(400)}" for _ in range(rng.choice([3, 9, 12, 20])))])) for i in range(120)]
    close = [(200 + i, " ".join([*template[:60], f"e{i}", *template[60:]])) for i in range(40)]
    data = [*family, *close]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 3, 80).collect()}
    exact = {d: c for d, (_, c) in brute.components(data, 3, 80).items()}
    assert got == exact and len(set(exact.values())) > 3


def test_elements_that_the_table_takes_for_rare(spark, monkeypatch):
    """Where few levels are known, elements of many sets still make no pairs, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "MAX_KNOWN", 3)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    rng = random.Random(3)
    bases = [[f"b{k}x{i}" for i in range(50)] for k in range(3)]
    data = []
    for i in range(90):
        w = list(bases[i % 3])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(50)] = f"z{rng.randrange(30)}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df, 3, 80).collect()}
    assert got == brute.components(data, 3, 80)


TOP = 2**63 - 1


@pytest.mark.parametrize("operator", ["jaccard", "similar"])
def test_any_long_is_an_id(spark, operator):
    base = [f"w{i}" for i in range(80)]
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (0, 1, 2, 79)]
    data = [(2**62 + 5, " ".join(base)), (TOP, near[0]), (TOP - 1, near[3]), (-TOP - 1, "quite another text that is alone in here"), (None, near[1]), (None, "one more text that is alone in this table"), (TOP, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    if operator == "jaccard":
        got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.components(df, 5, 80).collect()]
    else:
        got = [(r["doc_id"], r["class_id"]) for r in fingerprints.similar_classes(df).collect()]
    low = 2**62 + 5
    assert sorted(got, key=repr) == sorted([(low, low), (TOP, low), (TOP - 1, low), (-TOP - 1, -TOP - 1), (None, low), (None, None), (TOP, TOP)], key=repr)


def test_similar_classes_of_boilerplate(spark):
    """200 pairs of similarity 0.82 among texts that share boilerplate (0.79 across pairs): all are found."""
    rng = random.Random(5)
    shared = [f"w{i}" for i in range(400)]
    data, pairs = [], []
    for i in range(200):
        own = [f"p{i}x{j}" for j in range(12)]
        for half in (0, 1):
            data.append((2 * i + half, " ".join([*shared, *own, *(f"q{rng.getrandbits(50)}" for _ in range(40))])))
        pairs.append((2 * i, 2 * i + 1))
    sets = {d: brute.shingles(t, 5) for d, t in data}
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert min(j(a, b) for a, b in pairs) >= 0.8 > max(j(2 * i, 2 * i + 3) for i in range(199))
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.similar_classes(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: d - d % 2 for d in got}


def test_empty_tables(spark, none):
    assert fingerprints.similar_classes(none).count() == jaccard_join.components(none, count_links=True).count() == 0


CLASH = ["epochs", "target", "source_size", "shard", "slot", "lang_pred", "score", "_b", "extra", "taken", "row", "_t", "_id", "_h", "t", "rep", "n", "label", "component", "spans", "items"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'own' AS {c}" for c in CLASH]).repartition(3)


@pytest.mark.parametrize("name", ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"])
def test_stages_keep_columns_of_any_name(spark, name, odd_rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(odd_rows[5][1].split(" ")[:12])), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = [(2**63 - 1, "one more text of its own with the greatest id", "en", None, 1), (2**63 - 2, None, None, None, None), (-(2**63), "!!!", None, "s1", 1)]
    docs, stage = clashing(spark, [*odd_rows, *ids]), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    kept = [c for c in docs.columns if name != "sharding" or c not in ("shard", "slot")]
    assert out.columns == [*kept, "shard", "slot"] if name == "sharding" else out.columns == docs.columns
    rows = {tuple(r) for r in out.select(kept).collect()}
    assert rows <= {tuple(r) for r in docs.select(kept).collect()} and rows
    assert any(r[0] == 2**63 - 1 for r in rows) or name == "mixing"
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == out.columns and empty.count() == 0


def test_near_duplicates_keep_one_of_each_component(spark, tmp_path):
    """Also where the least id has two linked texts, ids are null or as large as can be, and rows repeat."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(80)]
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (0, 1, 2)]
    rows = [(1, " ".join(base)), (1, near[0]), (2, near[1]), (None, near[2]), (2**63 - 1, "clean text of the greatest id"), (None, "clean text of no id"), (None, "clean text of no id"), (7, "same row"), (7, "same row"), (8, ""), (9, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path)).collect()
    got = sorted((tuple(r) for r in kept), key=repr)
    linked = [r for r in got if r[1] in (rows[0][1], *near)]
    assert len(linked) == 1 and linked[0][0] == 1
    assert [r for r in got if r not in linked] == sorted({rows[4], rows[5], rows[7], rows[9], rows[10]}, key=repr)


def test_scratch(spark, tmp_path, monkeypatch):
    """Settings hold while any writer is at work and are restored; a cluster without a shared folder is an error."""
    import threading

    from tidemark.errors import InvalidArgument
    from tidemark.llm import scratch
    from tidemark.session import shared_dir

    was = {k: spark.conf.get(k, None) for k in scratch.SETTINGS}
    own = scratch.Scratch(spark, "test")
    threads = [threading.Thread(target=lambda i=i: own.write(spark.range(100), f"t{i}")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {k: spark.conf.get(k, None) for k in scratch.SETTINGS} == was and not scratch._WRITERS

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(InvalidArgument):
        shared_dir(Session)

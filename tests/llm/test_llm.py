"""Every operator against its plain version, on texts of all kinds: null, empty, very long, repeated, with clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat_format, decontamination, fingerprints, jaccard_join, language_id, license_scan, line_dedup, mixing, sharding, url_filter
from tidemark.llm.graph import connected_components
from tidemark.llm.license_rules import gate_terms, most_words, rules
from tidemark.llm.scratch import Scratch
from tidemark.llm.words import gram_hashes, shingle_lists, split_words, word_counts

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Words.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for spaced, plain in ((False, brute.alnum_words), (True, lambda t: brute.space_words((t or "").translate(brute.LOW)))):
        w = split_words(texts, spaced)
        for i, t in enumerate(texts):
            mine = [w.word(j) for j in range(w.first[i], w.first[i + 1])]
            assert mine == [x.encode("utf-8", "surrogatepass") for x in plain(t)]
        assert word_counts(texts, spaced).tolist() == [len(plain(t)) for t in texts]


def test_equal_words_have_equal_hashes():
    w = split_words(["Abc abd abc", "ABC"], True)
    assert w.hash[0] == w.hash[2] == w.hash[3] != w.hash[1]
    assert [len(s) for s in shingle_lists(["a b c d", "a b", "", None], 3)] == [2, 1, 0, 0]
    assert len(gram_hashes(w.hash, 9)) == 0


# 1. License scan.


def test_license_base_and_method(docs, doc_rows):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for d, t, *_ in doc_rows:
        n, found = brute.phrase_places(t, PHRASES)
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
        assert 0 <= r["score"] <= 1
    mixed = next(r for r in got.values() if r["text"] and "SA 4.0" in r["text"])
    assert mixed["base_labels"] == "apache-2,cc-by-nc,mit" and mixed["labels"] == "apache-2,cc-by-nc,cc-by-nc-sa,mit"


def test_license_suppression(spark):
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "SPDX-License-Identifier: Apache-2.0": "apache-2",
        "Distributed under the Frobnicate Public License": "licensed",
        "GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "see https://creativecommons.org/licenses/by-nd/4.0/": "cc-by-nd",
        "mit und permission": "",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["labels"] for r in license_scan.scan(df).collect()} == texts


def example(regex):
    """A text that a rule's regex matches: first alternatives, options left out."""
    regex = regex.replace("( [^ ]+){1,30}", " x").replace("( [^ ]+){1,4}", " x")
    while re.search(r"\([^()]*\)", regex):
        regex = re.sub(r"\([^()]*\)(\?|\{0,\d\})", "", regex)
        regex = re.sub(r"\(([^()|]*)[^()]*\)(\{1,\d\})?", r"\1", regex, count=1)
    regex = re.sub(r"\[([^\]])[^\]]*\](\{(\d)\}|\+)?\??", lambda m: m[1].replace("^", "a") * int(m[3] or 1), regex)
    return re.sub(r".\?", "", regex).replace("  ", " ").strip()


def test_license_rules_are_gated_and_reachable():
    all_rules = rules()
    assert len(all_rules) > 200 and [r.number for r in all_rules] == list(range(len(all_rules)))
    keywords, phrases = gate_terms()
    gated = lambda t: any(k in t for k in keywords) or any(w in t and re.search(p, t) for w, p in phrases)
    for r in all_rules:
        text = example(r.regex)
        m = re.match(f"^({r.regex})( |$)", text)
        assert m, (r.regex, text)
        assert text.split(" ")[0] in r.leads and gated(text), (r.regex, text)
        assert r.words >= len(text.split(" ")) and (not r.seconds or text.split(" ")[1] in r.seconds)


def test_license_windows_are_those_of_the_rules(spark):
    assert [most_words(x) for x in ("a", "a b( c)?", "(a|b c d) e", "a( [^ ]+){1,4} b", "a [0-9]{2} b", "a ( b|c){0,3}")] == [1, 3, 4, 6, 3, 5]
    with pytest.raises(ValueError):
        most_words("a( b)+")
    texts = {f"Neither the name of {' '.join(['Holder'] * n)} nor the names of its contributors": "bsd-3" if n <= 30 else "" for n in (1, 8, 9, 30, 31)}
    texts["this work is licensed under the a b c d licence"] = "licensed"
    texts["Permission: see the license file, no part of this book may be reproduced"] = "licensed,proprietary"
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["labels"] for r in license_scan.scan(df).collect()} == texts


def test_license_odd_and_empty(odd, none, odd_rows):
    assert license_scan.scan(odd).count() == len(odd_rows) and license_scan.scan(none).count() == 0
    many = "under the mit license " * 3000
    r = license_scan.scan(none.sparkSession.createDataFrame([(many,)], "text string")).first()
    assert (r["n_base"], r["last_word"], r["labels"]) == (3000, 4 * 2999, "mit")


# 2. Line dedup.


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(odd, odd_rows, batches):
    got = by_row(line_dedup.dedup_lines(odd, batches=batches), "doc_id", "n_lines", "n_dropped", "text")
    plain = brute.line_dedup([(r[0], r[1]) for r in odd_rows])
    assert got == sorted(((r[0], *x) for r, x in zip(odd_rows, plain, strict=True)), key=repr)


def test_line_dedup_of_any_id(spark):
    """The greatest number is an id like others; rows without an id come after it."""
    top, line = 2**63 - 1, "the same long line"
    rows = [(None, line), (top, line), (None, "only in rows without id"), (None, "only in rows without id"), (5, "a line of two documents"), (top, "a line of two documents"), (-top - 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = by_row(line_dedup.dedup_lines(df), "doc_id", "n_dropped", "text")
    plain = brute.line_dedup(rows)
    assert got == sorted(((d, x[1], x[2]) for (d, _), x in zip(rows, plain, strict=True)), key=repr)
    assert sum(r[1] for r in got) == 2


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "test"), fanout=2, buckets=2)
    for i in range(5):
        keys = spark.createDataFrame([(i, 0, i, i), (-1, 0, i, i)], "_ld_h1 long, _ld_h2 long, _ld_first long, _ld_last long")
        owner = {r["_ld_h1"]: r["_ld_owner"] for r in runs.add(keys, f"b{i}").collect()}
        assert owner == {i: i, -1: 0}
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert spark.table(runs.levels[2][0]).count() == 5
    runs.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_run")]


def test_line_dedup_empty(none):
    assert line_dedup.dedup_lines(none).count() == 0


# 3. URL filter.

URLS = [
    None, "no scheme", "http://EXAMPLE.com/en/7", "http://a.example.com/en/712?x", "https://com/en/", "http://xcom/en/1", "http://a.net/de/8", "http://b.example.net/de/8#t",
    "ftp://x.org/es/", "http://x.org?/es/", "http://x.org/a://b.com/en/1", "http://", "http://h.com/EN/7", "http://user@H.com:80/en/", "://h.com/en/\n2",
]


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].translate(brute.LOW), m[2]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for r in url_filter.judge(pages).collect():
        host, path, rule = plain_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        if rule:
            assert r["verdict"] == rule.verdict
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages.union(pages).selectExpr("*", "'x' AS host", "'y' AS verdict", "1 AS trust")).count() == 2 * len(URLS)


def test_url_propagation(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.{t}" for i in range(6) for t in ("com", "net", "org", "info")]
    rows = []
    for i in range(150):
        h = rng.choice(hosts)
        links = "".join(f'<a HREF="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts).upper()}/x">' for _ in range(rng.randint(0, 4))) + '<a href="/own"><a href="#top"><a href=mailto:x@y.z><a href=""><a href="//">'
        rows.append((i, f"http://{h}{rng.choice(['/en/1', '/de/2', '/es/3', '/fr/4'])}", links))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), threshold=0.12).collect()}
    good, bad, pages, edges = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for _, u, html in rows:
        host, _, rule = plain_url(u)
        pages[host] += 1
        good[host] += bool(rule and rule.verdict == "allow")
        bad[host] += bool(rule and rule.verdict == "block")
        for to in re.findall(r'HREF="(?:https?:)?//([^/]+)/x', html):
            edges[host, to.lower()] += 1
        edges[host, host] += 1
    trust = brute.pagerank(edges, good, url_filter.DAMPING)
    distrust = brute.pagerank({(t, s): n for (s, t), n in edges.items()}, bad, url_filter.DAMPING)
    blocked = {h for h in pages if round((distrust.get(h, 0) - trust.get(h, 0)) / pages[h], 9) >= 0.12}
    assert 0 < len(blocked) < len(pages)
    for i, u, _ in rows:
        host, _, rule = plain_url(u)
        assert got[i] == (rule.verdict if rule else "block" if host in blocked else "allow")


# 4. Decontamination.


def test_decontamination(spark, odd, odd_rows, doc_rows, none, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join((r[1] or "").split(" ")[2:40])) for i, r in enumerate(doc_rows[10:30:4])]
    items += [(50, "seven Eight nine"), (51, None), (52, "!!"), (53, items[0][1]), (54, "w5 " * 12), (None, "one two"), (55, " ".join(f"w{i}" for i in range(29_000, 29_020)))]
    items += [(56 + k, " ".join(rng.choice("ab") for _ in range(15))) for k in range(3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else i, t) for i, t in items]
    expected = sorted(((r[0], *brute.contamination(r[1], named)) for r in odd_rows), key=repr)
    assert by_row(decontamination.digest(decontamination.find_spans(odd, bench)), "*") == expected
    clean = decontamination.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(not e[-1] for e in expected)
    for limit in ("MAX_SPREAD", "MAX_SPREAD_WIDE"):  # nothing is spread
        monkeypatch.setattr(decontamination, limit, -1)
    assert by_row(decontamination.digest(decontamination.find_spans(odd, bench)), "*") == expected
    assert decontamination.drop_contaminated(odd, bench).count() == clean.count()
    assert decontamination.find_spans(none, bench).count() == decontamination.drop_contaminated(none, bench).count() == 0
    assert by_row(decontamination.digest(decontamination.find_spans(odd, bench.limit(0))), "contaminated") == [(False,)] * len(odd_rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 2), min_size=1, max_size=30))
def test_winnowing_misses_no_window(doc, item):
    """Few different words: as many ties and repeats as can be."""
    d, i = " ".join(map(str, doc)), " ".join(map(str, item))
    lengths = [len(item)] if len(item) < decontamination.SPAN else []
    sides = [split_words([x], False) for x in (d, i)]
    grams = [gram_hashes(w.hash, decontamination.GRAM) for w in sides]
    hits = np.intersect1d(*(decontamination.prints(w, 0, len(w.hash), g, lengths) for w, g in zip(sides, grams, strict=True)))
    n = min(decontamination.SPAN, len(item))
    windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
    found = decontamination.places(sides[0], 0, len(doc), grams[0], lengths, hits)
    hit = {j for n, starts in found for s in starts.tolist() if tuple(doc[s : s + n]) in windows for j in range(s, s + n)}
    assert (len(hit), bool(hit)) == brute.contamination(d, [(1, i)])[1::3]


# 5. Jaccard join.


@pytest.mark.parametrize(("words", "percent", "hot"), [(3, 90, 32), (5, 80, 1), (1, 60, 2), (2, 50, 2)])
def test_jaccard_components(docs, doc_rows, words, percent, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "COUNT_CHUNK", 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs, words, percent).collect()}
    assert got == brute.components([(r[0], r[1]) for r in doc_rows], words, percent)


def test_jaccard_odd_rows(odd, odd_rows, none):
    out = jaccard_join.components(odd, 3, 90)
    assert out.count() == len(odd_rows) and jaccard_join.components(none).count() == 0
    copies = {r["component_id"] for r in out.collect() if r["doc_id"] == odd_rows[41][0]}
    assert len(copies) == 1
    assert sorted((r["component_id"] for r in out.where("doc_id is null").collect()), key=repr)[-2:] == [None, None]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=9), st.sampled_from([50, 80, 90]))
def test_block_links_connect_what_links_connect(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    parts = {i: {i} for i in range(len(sets))}
    for a, b in jaccard_join.block_links(np.arange(len(sets)), arrays, percent):
        both = parts[a] | parts[b]
        parts.update(dict.fromkeys(both, both))
    plain = {i: {i} for i in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                both = plain[a] | plain[b]
                plain.update(dict.fromkeys(both, both))
    assert parts == plain


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {k: v for k, v in comp.items() if any(k in e and e[0] != e[1] for e in edges)}


# 6. Fingerprints.


def test_fingerprints(odd, odd_rows, none, monkeypatch):
    def check():
        got = collections.defaultdict(list)
        for r in fingerprints.edited_likeness(odd).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(odd_rows)
        ids = sorted({r[0] for r in odd_rows if r[0] is not None}, reverse=True) + [None]
        texts = {d: [r[1] or "" for r in odd_rows if r[0] == d] for d in ids}
        for k, d in enumerate(ids):
            n = ids[(k + 1) % len(ids)]
            if len(texts[d]) == 1:
                t, r = texts[d][0], got[d][0]
                cut = len(t) // 3
                assert r["n_chars"] == len(t) and r["edited_sha256"] in {brute.sha(t[: len(t) - cut] + f[:cut]) for f in texts[n]}
                if len(texts[n]) == 1:
                    near = lambda a, b: np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)])
                    assert r["near_next"] == pytest.approx(near(r["fingerprint"], got[n][0]["fingerprint"]))
                    assert r["near_edited"] == pytest.approx(near(r["fingerprint"], r["edited_fingerprint"]))
        prints = collections.defaultdict(set)
        for rows in got.values():
            for r in rows:
                prints[r["n_chars"], r["fingerprint"]].add(r["doc_id"])
        base = odd_rows[46][1]
        assert sum(1 for k, v in prints.items() if odd_rows[46][0] in v and odd_rows[47][0] in v and k[0] == len(base)) == 1

    check()
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 5)
    check()
    assert fingerprints.edited_likeness(none).count() == 0


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    a, b = " ".join(w), " ".join(w[:400] + [f"v{i}" for i in range(200)])
    x, y = brute.shingles(a, 5), brute.shingles(b, 5)
    p = fingerprints.fingerprint_texts([a, b])
    assert abs(fingerprints.likeness(p[0], p[1]) - len(x & y) / len(x | y)) < 0.15


def test_fingerprints_are_plain_minhash():
    """One shingle, one permutation after the other, in Python's own numbers."""
    rng = random.Random(7)
    for text in ("", "a", "One two THREE", " ".join(f"w{rng.randint(0, 50)}" for _ in range(300)), "x " * 40):
        hashes = {int(h) for h in shingle_lists([text], 5)[0]}
        assert len(hashes) == len(brute.shingles(text, 5))
        plain = []
        for a, b in zip(fingerprints._A.tolist(), fingerprints._B.tolist(), strict=True):
            least = min(((a * h + b) % 2**64 for h in hashes), default=2**64 - 1)
            plain.append(f"{least // 2**24 % 2**16:04x}")
        assert fingerprints.to_text(fingerprints.fingerprint_texts([text])) == ["".join(plain)]


def test_signatures_of_pairs_are_those_of_each():
    rng = np.random.Generator(np.random.PCG64(3))
    lists = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 7, 300, 40_000, 0)]
    changed = [np.concatenate([x[: 2 * len(x) // 3], rng.integers(0, 2**64, k, dtype=np.uint64)]) for x, k in zip(lists, (0, 1, 2, 100, 13_000, 5), strict=True)]
    for left, right in ((lists, changed), (changed, lists), (lists, lists), ([], [])):
        for got, plain in zip(fingerprints.pair_signatures(left, right), (left, right), strict=True):
            assert (got == fingerprints.signatures(plain)).all()


def test_packed_fingerprints_come_back():
    rng = np.random.Generator(np.random.PCG64(4))
    own = rng.integers(0, 3, (50, fingerprints.PERMUTATIONS)).astype(np.uint16)
    for changed in (own, own[::-1], own + np.uint16(7)):
        got = [fingerprints.unpacked(x, y) for x, y in zip(fingerprints.to_bytes(own), fingerprints.packed(own, changed), strict=True)]
        assert got == fingerprints.to_bytes(changed)


@pytest.mark.parametrize("bounds", [[], [5], [-(2**63), 0, 3, 9, 2**63 - 1], list(range(0, 1000, 7))])
def test_ranges_count_bounds(spark, bounds):
    ids = [None, -(2**63), -1, 0, 1, 3, 5, 7, 9, 693, 694, 994, 995, 2**63 - 1]
    number, is_bound = fingerprints._range_of(F.col("i"), bounds)
    for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", number.alias("n"), is_bound.alias("b")).collect():
        assert (r["n"], r["b"]) == ((0, False) if r["i"] is None else (sum(x < r["i"] for x in bounds), r["i"] in bounds))


def test_fingerprints_of_any_id(spark, monkeypatch):
    """Ids that floats can't hold stay as they are beside null ids, and classes come along."""
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 2)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(2**63 - 1, base), (2**63 - 2, base + " end"), (2**53 + 1, "other words"), (2**53, None), (-(2**63), base), (None, base + " last"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS class_id", "'y' AS r", "'z' AS label", "1 AS copy").repartition(2)
    got = fingerprints.fingerprint_documents(df).collect()
    low = -(2**63)
    assert sorted(((r["doc_id"], r["class_id"], r["n_chars"]) for r in got), key=repr) == sorted(((d, low if t and t.startswith("w0") else d, len(t or "")) for d, t in rows), key=repr)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2**63 - 1]["near_next"] == pytest.approx(np.mean([a == b for a, b in zip(*(fingerprints.fingerprint_texts([x])[0] for x in (base, base + " end")), strict=True)]))
    assert fingerprints.fingerprint_documents(df.limit(0)).count() == 0


def test_similar_classes(docs, doc_rows):
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.similar_classes(docs).collect()}
    plain = brute.components([(r[0], r[1]) for r in doc_rows], 5, 80)
    exact = {d: c for d, (n, c) in plain.items()}
    assert set(got) == set(exact)
    assert all(exact[d] == exact[c] for d, c in got.items())  # verified: no false links
    assert got == exact


# 7. Mixing.


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


def test_min_cost_flow_spreads_repeats():
    thrice = lambda n: [n, n, n]
    flow = mixing.min_cost_flow([thrice(10), thrice(10)], [{0: 30, 1: 30}, {1: 30}], [12, 20])
    assert sum(v for (_, s), v in flow.items() if s == 0) == 12 and sum(v for (_, s), v in flow.items() if s == 1) == 20
    flow = mixing.min_cost_flow([thrice(10), thrice(10)], [{0: 30}, {0: 30}], [20])
    assert flow == {(0, 0): 10, (1, 0): 10}  # no repeats while there are fresh tokens
    assert sum(mixing.min_cost_flow([thrice(5)], [{0: 15}], [100]).values()) == 15
    assert mixing.min_cost_flow([], [], []) == {}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_min_cost_flow_is_cheapest(data):
    """Against successive cheapest paths, one token at a time."""
    n_p, n_s = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 3))
    offers = [data.draw(st.lists(st.integers(0, 4), min_size=1, max_size=3)) for _ in range(n_p)]
    reach = [{s: data.draw(st.integers(0, 8)) for s in data.draw(st.sets(st.integers(0, n_s - 1)))} for _ in range(n_p)]
    quota = [data.draw(st.integers(0, 9)) for _ in range(n_s)]
    flow = mixing.min_cost_flow(offers, reach, quota)
    used = [sum(v for (p, _), v in flow.items() if p == q) for q in range(n_p)]
    cost = lambda p, n: sum(sorted(r for r, k in enumerate(offers[p]) for _ in range(k))[:n])
    assert all(0 < v <= reach[p].get(s, 0) for (p, s), v in flow.items()) and all(u <= sum(o) for u, o in zip(used, offers, strict=True))
    assert all(sum(v for (_, x), v in flow.items() if x == s) <= quota[s] for s in range(n_s))
    assert (sum(flow.values()), sum(cost(p, u) for p, u in enumerate(used))) == brute.cheapest_flow(offers, reach, quota)


def test_flow_of_many_patterns_is_quick():
    rng = random.Random(1)
    members = [rng.sample(range(40), rng.randint(1, 4)) for _ in range(20_000)]
    size = [rng.randint(1, 10**6) for _ in members]
    own = [sum(c for c, m in zip(size, members, strict=True) if s in m) for s in range(40)]
    quota = [round(x) for x in mixing.targets(own, total=sum(size))]
    flow = mixing.min_cost_flow([[c] * 3 for c in size], [dict.fromkeys(m, 3 * c) for c, m in zip(size, members, strict=True)], quota)
    assert sum(flow.values()) == sum(quota)


def taken_of_sources(rows, got):
    """rows: (source, size) as given, got: (source, size, source_size, target, taken). Checks what holds for every mix."""
    sizes = collections.Counter()
    for s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute.shares([sizes[s] for s in names]), strict=True))
    taken = collections.Counter()
    for s, size, source_size, t, k in got:
        assert (source_size, t) == (sizes[s], pytest.approx(target[s])) and 0 <= k <= 3 * size
        taken[s] += k
    return target, taken


def test_mixing(odd, odd_rows, none):
    sized = odd.select("doc_id", "source", F.xxhash64("text").alias("h"), mixing.word_count(F.col("text")).alias("size"), "taken", "epochs", "extra", F.lit("x").alias("source_size"), F.lit("y").alias("target"))
    run = lambda: by_row(mixing.mix(sized, F.col("source"), F.col("h"), ["doc_id"], F.col("size")), "doc_id", "source", "size", "source_size", "target", "taken", "epochs", "extra")
    got = run()
    assert got == run() and len(got) == len(odd_rows) and {r[6:] for r in got} == {("x", "x")}
    target, taken = taken_of_sources([(r[3], len(brute.space_words(r[1]))) for r in odd_rows], [r[1:6] for r in got])
    largest = max(target, key=target.get)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(60, 0.05 * target[s]) or s == largest  # one text is nearly all of its source
    numbers = none.select("doc_id", "source", F.lit(0).cast("long").alias("size"))
    assert mixing.mix(numbers, F.col("source"), F.col("doc_id"), ["doc_id"], F.col("size")).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [10**9, 20])
def test_mixing_overlapping_sources(spark, rows_per_bucket, monkeypatch):
    """Equal texts in several sources: every quota is met nearly, and unique texts come before further copies of shared ones."""
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = random.Random(4)
    sources = ["a", "b", None, "c"]
    rows = []
    for t in range(400):
        size = rng.randint(1, 50)
        rows += [(t, s, size) for s in (rng.sample(sources, rng.randint(1, 4)) if t % 2 else [rng.choice(sources)])]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, t long, source string, size long").repartition(3)
    got = mixing.mix(df, F.col("source"), F.col("t"), ["doc_id"], F.col("size")).collect()
    target, taken = taken_of_sources([r[2:] for r in rows], [(r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got])
    assert all(abs(taken[s] - target[s]) <= 30 for s in target), (target, taken)
    copies = collections.Counter()
    for r in got:
        copies[r["t"]] += r["epochs_taken"]
    alone = {r[1] for r in rows if r[1] % 2 == 0 and r[2] == "a"}
    shared = {t for t in copies if t % 2 and sum(r[1] == t for r in rows) > 1}
    assert min(copies[t] for t in alone) >= 1 and max(copies[t] for t in shared) <= 8


# 8. Sharding.


def test_sharding(odd, odd_rows, none):
    ids = ["doc_id", "h"]
    df = odd.withColumn("h", F.xxhash64("text"))
    got = sharding.shard_rows(df, ids, shards=7, buckets=5)
    rows = got.select("doc_id", "shard", "slot").collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in slots.values()]
    assert len(rows) == len(odd_rows) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard_rows(df.repartition(5), ids, shards=7, buckets=5)
    assert by_row(got, "doc_id", "h", "shard", "slot") == by_row(again, "doc_id", "h", "shard", "slot")
    assert sharding.shard_rows(none, ["doc_id"]).count() == 0
    assert sharding.shard_rows(odd.limit(2).withColumn("h", F.lit(1)), ids, shards=24).count() == 2


def test_sharding_of_rows_with_equal_ids(spark):
    """Rows that differ in other columns only, some of names that the operator used itself: the same places whatever the order they come in."""
    df = spark.range(300).select(F.lit(1).alias("doc_id"), (F.col("id") % 100).alias("_b"), F.lit("x").alias("_k"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("other"), F.create_map(F.lit("a"), F.col("id") % 3).alias("m"))
    one, two = (sharding.shard_rows(d, ["doc_id"], shards=5, buckets=3).select("_b", "other", F.col("m").cast("string"), "shard", "slot").collect() for d in (df, df.orderBy(F.desc("_b")).repartition(4)))
    assert sorted(one, key=repr) == sorted(two, key=repr) and len({(r["shard"], r["slot"]) for r in one}) == 300


def test_matrix_margins_and_law():
    rows = np.array([0, 5, 100, 1, 37])
    m = sharding.draw_matrix(rows, 6, 3)
    assert (m.sum(axis=1) == rows).all() and sorted(m.sum(axis=0)) == sorted([24, 24, 24, 24, 24, 23])
    first = np.array([sharding.draw_matrix(np.array([20, 60]), 4, s)[0, 0] for s in range(2000)])
    var = 20 * 0.25 * 0.75 * 60 / 79
    assert abs(first.mean() - 5) < 0.2 and abs(first.var() / var - 1) < 0.15


# 9. Chat formatting.


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), st.text(alphabet="<|\\endtx> é\n\U0001f600!", max_size=20)), min_size=1, max_size=6))
def test_rendering_is_reversible(turns):
    text, spans = chat_format.render(turns, "assistant")
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_token_mask_by_binary_search():
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 8))
        spans = [(cuts[i], cuts[i + 1]) for i in range(0, 8, 2)]
        starts = np.array(sorted(rng.sample(range(60), 12)))
        ends = starts + rng.randint(1, 4)
        plain = [any(a < e and s < b for a, b in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat_format.token_mask(starts, ends, spans).tolist() == plain


def test_chat(spark):
    case = "</s>[INST] ok [/INST]"
    rows = [
        (-1, 0, "user", case), (-1, 1, "assistant", case),
        (1, 1, "assistant", "Héllo <|end|> <\\|x\n  two  spaces "), (1, 0, "system", None), (1, 2, "user", "q"), (1, 3, "assistant", ""), (1, 4, "assistant", "\U0001f600!<"), (1, 5, "assistant", "|b"),
        (2, 0, "user", "only"), (None, None, None, None), (None, 1, "assistant", "a"), (3, 0, "assistant", "word " * 3000), (1, 2, "user", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), brute.sha("".join(f"{x}\n{t}\n" for _, x, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
    out = chat_format.format_conversations(df).where("conv_id = 1").first()
    assert len(out["input_ids"]) == len(out["loss_mask"]) == len(out["token_start"])
    large = spark.createDataFrame([(2**63 - 1, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (None, 0, "user", "c")], "conv_id long, turn long, role string, text string").withColumn("none", F.lit("x")).coalesce(1)
    assert {r["conv_id"] for r in chat_format.read_back(chat_format.format_conversations(large)).collect()} == {2**63 - 1, 2**53 + 1, None}
    with pytest.raises(Exception, match="no tokenizer at /nowhere"):
        chat_format.format_conversations(df, tokenizer="/nowhere").collect()
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# 10. Language ID.


def test_language_id(odd, odd_rows, none):
    profiles = language_id.learn(odd, "text", "lang")
    assert set(profiles) == {"de", "en"} and all(len(p) <= language_id.TOP for p in profiles.values())
    got = language_id.predict(odd, "text", profiles).select("doc_id", "text", "lang", "lang_pred", "score").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    long = [r for r in got if r["text"] and len(r["text"]) > 200 and r["lang"] and "w29999" not in r["text"]]
    assert sum(r["lang"] == r["lang_pred"] for r in long) >= 0.95 * len(long)
    assert language_id.learn(none, "text", "lang") == {}
    assert {r["lang_pred"] for r in language_id.predict(odd, "text", {}).collect()} == {"und"}
    assert language_id.predict(none, "text", profiles).count() == 0


def test_out_of_place_distance():
    """Against the plain definition on dictionaries."""
    texts = {"x": "abc abd abc zab", "y": "zzy zyx yyz zz"}
    profiles = {k: language_id._ranked(*language_id._counts(next(language_id._grams([t]))), 10) for k, t in texts.items()}
    run = language_id.predictor(profiles, 10)
    for t in ["abc", "zyx zz", "q", "ABC abd"]:
        mine = language_id._ranked(*language_id._counts(next(language_id._grams([t]))), 10).tolist()
        far = {k: sum(abs(p.tolist().index(g) - i) if g in p else 10 for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert run([t]) == [(best, pytest.approx(1 - far[best] / (10 * len(mine))))]


def test_profiles_are_plain_counts(spark, monkeypatch):
    """``learn`` over many batches and tasks gives the profile of one count over all texts of a label."""
    rng = random.Random(11)
    rows = [(rng.choice(["x", "y"]), " ".join("".join(rng.choice("abcÄz ") for _ in range(6)) for _ in range(rng.randint(1, 30)))) for _ in range(60)]
    rows += [(None, "aaaa"), ("x", None), ("y", ""), ("z", "123")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = language_id.learn(df, "text", "lang", top=40)
    for lang in ("x", "y"):
        counts = collections.Counter()
        for label, t in rows:
            if label == lang and t:
                counts.update(next(language_id._grams([t])).tolist())
        assert got[lang].tolist() == [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], -x[0]))[:40]]
    assert set(got) == {"x", "y"}


def test_grams_are_counted_as_defined():
    """n-grams of one to three characters of lower-case words with a mark at each border, none of marks alone."""
    plain = collections.Counter()
    text = "Ab, c  ÄB7x"
    marked = "_" + "_".join(re.findall(r"[^\W\d_]+", text.lower())) + "_"
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if g.strip("_") and not (n == 1 and g == "_"):
                plain[g] += 1
    got = collections.Counter(next(language_id._grams([text])).tolist())
    assert sorted(plain.values()) == sorted(got.values())


# Pipeline and registered queries.


def test_pipeline(spark, odd_rows, doc_rows, tmp_path):
    import corpus_pipeline as c

    rows = [*doc_rows, doc_rows[41], doc_rows[41], (None, "alone and never seen before", None, None, 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(doc_rows[5][1].split(" ")[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
        if name != "sharding":
            assert docs.columns == before.columns
    before, after = seen["language_id"]
    assert collections.Counter(after) == collections.Counter(r for r in before if any(x.isalpha() for x in r["text"] or ""))
    before, after = seen["near_duplicates"]
    plain = brute.components({r["doc_id"]: (r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None}.values(), 5, 80)
    assert sorted((r["doc_id"] for r in after), key=repr) == sorted([*(d for d, (_, comp) in plain.items() if d == comp), None], key=repr)
    odd = c.drop_near_duplicates(spark, spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert odd.count() == odd.dropDuplicates(["doc_id", "text"]).count() <= len(odd_rows)
    before, after = seen["decontamination"]
    items = [(1, " ".join(doc_rows[5][1].split(" ")[:12]))]
    assert collections.Counter(after) == collections.Counter(r for r in before if not brute.contamination(r["text"], items)[-1]) and len(after) < len(before)
    before, after = seen["mixing"]
    assert set(after) <= set(before) and max(collections.Counter(after).values()) <= 3
    before, after = seen["sharding"]
    assert collections.Counter(r[:5] for r in after) == collections.Counter(tuple(r) for r in before)
    per = collections.Counter(r["shard"] for r in after)
    assert max(per.values()) - min(per.get(i, 0) for i in range(24)) <= 1
    assert c.ORACLE_SQL is None


def test_queries_take_whole_tables(spark):
    from tidemark.llm.registry import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    for name in ("op1_license_scan", "op3_url_filter", "op8_sharding", "op10_language_id"):
        assert queries()[name](spark, sf).count() == n["pages" if "url" in name else "documents"]
    shards = queries()["op8_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in shards)
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")

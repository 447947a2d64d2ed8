"""License scan by ordered signature rules.

A keyword prefilter over the raw text decides which texts are looked at. In those, words are taken. A place is tried if its word,
and the next one where that is fixed as well, can begin a rule; it is tried against the rules of that word only, which are
literal regexes over the next words (as many as the longest rule can match). At one place the best rule stays: the earliest tier, then
the longest match, then the first rule. A detection is dropped if one that starts before it covers it and is of the same or an
earlier tier, or if one of an earlier tier overlaps it. The base phrases are the rules of tier 0; they are detected for
themselves and nothing drops them.

All of it is one projection of built-in functions: no shuffle, no Python. Work grows with the length of a text: a place looks
at a bounded number of words, and covering and overlap are looked for among as many detections before and after.

Defined results: null text is empty: no words, no labels (empty strings), score 0, null places. Rows are kept one for one
with all their columns, repeated rows and null ids as well; columns that clash with results are replaced, and columns that begin with
``_ls_`` are the operator's own. Rules of one label at one place give it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_rules import CONFIDENCE, Rule, gate_terms, rules
from tidemark.llm.words import ALNUM_WORD, ALNUM_WORD_RAW, LOWER, UPPER


def _by_lead(given: list[Rule]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in given:
        for lead in r.leads:
            out.setdefault(lead, []).append(r)
    return out


def _quote(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(_quote, values))})" if values else "false"


def _detections(places: str, by_lead: dict[str, list[Rule]]) -> Column:
    """The best detection at each place (``i``, ``lead``, ``next``: the words from there on) that has one.

    Written as SQL: hundreds of rules as Columns would take seconds to build. Patterns are literals, compiled once a task.
    """

    def tried(r: Rule) -> str:
        match = f"regexp_extract(p.next, {_quote(f'^({r.regex})( |$)')}, 1)"
        found = f"named_struct('tier', {r.tier}, 'minus', -size(split({match}, ' ')), 'rule', {r.number}, 'label', {_quote(r.label)})"
        return f"CASE WHEN {match} <> '' THEN {found} END"

    cases = " ".join(f"WHEN {_quote(lead)} THEN array_min(array({', '.join(map(tried, own))}))" for lead, own in by_lead.items())
    best = f"CASE p.lead {cases} END" if cases else "null"
    end = "named_struct('first', x.i, 'end', x.i - x.b.minus, 'tier', x.b.tier, 'rule', x.b.rule, 'label', x.b.label)"
    return F.expr(f"transform(filter(transform({places}, p -> named_struct('i', p.i, 'b', {best})), x -> x.b IS NOT NULL), x -> {end})") if cases else F.lit(None)


def scan(docs: DataFrame, text: str = "text", ordered_rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and
    ``detections`` (array of first word, end, tier, rule number, label; in order of place)."""
    all_rules = rules() if ordered_rules is None else ordered_rules
    window = max(r.words for r in all_rules)
    alone = sorted({x for r in all_rules if not r.seconds for x in r.leads})
    pairs = sorted({f"{x} {y}" for r in all_rules for x in r.leads for y in r.seconds})
    leads = sorted({x for r in all_rules for x in r.leads})

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("n_words", F.regexp_count(body, F.lit(ALNUM_WORD_RAW)).cast("long"))
    out = out.withColumn("_ls_text", F.translate(body, UPPER, LOWER))
    low, (keywords, phrases) = F.col("_ls_text"), gate_terms()
    gated = F.lit(False)
    for k in keywords:
        gated |= F.contains(low, F.lit(k))
    for word, phrase in phrases:  # the regular expression only where its longest word is
        gated |= F.contains(low, F.lit(word)) & low.rlike(phrase)
    out = out.withColumn("_ls_words", F.when(gated, F.regexp_extract_all(low, F.lit(ALNUM_WORD), F.lit(0)))).drop("_ls_text")
    begins = f"{_among('x', leads)} AND ({_among('x', alone)} OR {_among("concat_ws(' ', x, get(_ls_words, i + 1))", pairs)})"
    place = f"named_struct('i', i, 'lead', _ls_words[i], 'next', array_join(slice(_ls_words, i + 1, {window}), ' '))"
    out = out.withColumn("_ls_places", F.expr(f"transform(filter(transform(_ls_words, (x, i) -> CASE WHEN {begins} THEN i END), i -> i IS NOT NULL), i -> {place})"))
    none = F.array().cast("array<struct<first:int,end:int,tier:int,rule:int,label:string>>")
    for name, tiers in (("_ls_found", lambda r: r.tier > 0), ("_ls_base", lambda r: r.tier == 0)):
        out = out.withColumn(name, F.coalesce(_detections("_ls_places", _by_lead([r for r in all_rules if tiers(r)])), none))
    d = F.col("_ls_found")

    def stays(x: Column, k: Column) -> Column:
        near = F.slice(d, F.greatest(k - (window - 1), F.lit(1)), F.lit(2 * window + 1))
        covers = lambda o: (o["first"] < x["first"]) & (o["end"] >= x["end"]) & (o["tier"] <= x["tier"])
        prevails = lambda o: (o["tier"] < x["tier"]) & (o["first"] < x["end"]) & (o["end"] > x["first"])
        return ~F.exists(near, lambda o: covers(o) | prevails(o))

    base = F.col("_ls_base")
    out = out.withColumn("detections", F.array_sort(F.concat("_ls_base", F.filter(d, stays))))
    found = F.col("detections")
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    tier = F.array_min(F.transform(found, lambda x: x["tier"]))
    return out.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(F.transform(base, lambda x: x["first"])).cast("long"),
            "last_word": F.array_max(F.transform(base, lambda x: x["first"])).cast("long"),
            "base_labels": names(base),
            "labels": names(found),
            "score": F.when(tier.isNull(), F.lit(0.0)).otherwise(F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), tier + 1)),
        }
    ).drop("_ls_words", "_ls_places", "_ls_found", "_ls_base")


def oracle(sf_table: str = "documents") -> str:
    """The same in DuckDB's SQL: places joined with the rules, best rule at each place, covered detections dropped."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({r.number}, {r.tier}, {quote(r.label)}, {quote(f'^({r.regex})( |$)')}, {quote(lead)})" for r in rules() for lead in dict.fromkeys(r.leads))
    scores = " ".join(f"WHEN {i} THEN {c}::DOUBLE" for i, c in enumerate(CONFIDENCE))
    return rf"""
WITH rules(rule, tier, label, regex, lead) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM {sf_table}),
p AS (SELECT doc_id, i - 1 AS first, w[i] AS word, array_to_string(w[i:i + {max(r.words for r in rules()) - 1}], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
h AS (SELECT doc_id, first, first + len(string_split(regexp_extract(win, regex, 1), ' ')) AS stop, tier, rule, label
      FROM p JOIN rules ON p.word = rules.lead WHERE regexp_matches(win, regex)),
b AS (SELECT * FROM h WHERE tier > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, first ORDER BY tier, stop DESC, rule) = 1),
k AS (SELECT * FROM b WHERE NOT EXISTS (
        SELECT 1 FROM b o WHERE o.doc_id = b.doc_id
        AND (o.first < b.first AND o.stop >= b.stop AND o.tier <= b.tier OR o.tier < b.tier AND o.first < b.stop AND o.stop > b.first))
      UNION ALL SELECT * FROM h WHERE tier = 0),
a AS (SELECT doc_id, count(*) FILTER (tier = 0) AS n_base, min(first) FILTER (tier = 0) AS first_word, max(first) FILTER (tier = 0) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (tier = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(tier) AS tier
      FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(a.n_base, 0)::BIGINT AS n_base, a.first_word::BIGINT AS first_word, a.last_word::BIGINT AS last_word,
       coalesce(a.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(CASE a.tier {scores} END, 0.0::DOUBLE) AS score
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""

"""Fill-in-middle: cut each text into prefix, middle and suffix at token bounds, and write the parts in another order.

Tokens are maximal runs of ASCII letters and single other code points. One Aho-Corasick automaton over classes of ASCII characters
finds where letters begin and end, and the sentinels. Between two such events a run of letters is one token and any other gap as many
as it has code points, so the events alone say how many tokens there are and, by binary search, where the token of any rank begins.

Python sees the text and the two ranks and gives back four numbers; parts are cut and joined by column functions. No shuffle: a row is
judged by itself, so a lost executor costs only its running tasks; arrays are made for one text at a time, some 20 bytes a code point.
"""

from __future__ import annotations

from collections import deque
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of these so many suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of characters: those of the sentinels have one each; then other letters, and all else.
_SPECIAL = sorted(set(PREFIX + SUFFIX + MIDDLE))
_LETTER, _OTHER = len(_SPECIAL), len(_SPECIAL) + 1
_CHANGE, _SENTINEL = 1, 2
_COLUMNS = "struct<n: long, marked: boolean, a: long, b: long>"


def _is_letter(symbol: int) -> bool:
    return symbol == _LETTER or symbol < len(_SPECIAL) and _SPECIAL[symbol].isalpha()


def _patterns() -> dict[tuple[int, ...], int]:
    """What the automaton looks for: two characters of which one is a letter, and the sentinels."""
    symbols = range(_OTHER + 1)
    out = {(x, y): _CHANGE for x in symbols for y in symbols if _is_letter(x) != _is_letter(y)}
    return out | {tuple(map(_SPECIAL.index, s)): _SENTINEL for s in (PREFIX, SUFFIX, MIDDLE)}


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte, the state after each state and class, and what each state says (bits of ``_CHANGE`` and ``_SENTINEL``)."""
    goto: list[dict[int, int]] = [{}]
    says = [0]
    for pattern, mark in _patterns().items():
        at = 0
        for x in pattern:
            if x not in goto[at]:
                goto[at][x] = len(goto)
                goto.append({})
                says.append(0)
            at = goto[at][x]
        says[at] |= mark
    step = np.zeros((len(goto), _OTHER + 1), np.uint8)
    fail, queue = [0] * len(goto), deque([0])
    while queue:  # by depth, so that a state's suffix is done before it
        at = queue.popleft()
        says[at] |= says[fail[at]]
        for x in range(_OTHER + 1):
            behind = step[fail[at], x] if at else 0
            step[at, x] = goto[at].get(x, behind)
            if x in goto[at]:
                fail[goto[at][x]] = int(behind)
                queue.append(goto[at][x])
    classes = np.full(256, _OTHER, np.uint8)
    classes[[*range(65, 91), *range(97, 123)]] = _LETTER
    for i, c in enumerate(_SPECIAL):
        classes[ord(c)] = i
    return classes, step, np.array(says, np.uint8)


def events(text: bytes) -> np.ndarray:
    """What the automaton says at each byte. No pattern is longer than three, so the last three classes lead from the root to its state."""
    classes, step, says = automaton()
    c = np.concatenate([np.full(2, _OTHER, np.uint8), classes[np.frombuffer(text, np.uint8)]])
    # Two symbols of the last class stand before the text: they are no letters and begin no sentinel; a change at the first byte is no gap's end.
    out = says[step[step[step[0, c[:-2]], c[1:-1]], c[2:]]]
    out[:1] &= ~np.uint8(_CHANGE)
    return out


def cut(text: str | None, low: int, high: int) -> tuple[int, bool, int, int]:
    """Number n of tokens, whether a sentinel occurs, and the code points before the tokens of ranks ``low`` and ``high`` modulo n + 1, the smaller first."""
    # One byte a code point: what isn't ASCII is no letter and in no sentinel.
    data = (text or "").encode("ascii", "replace")
    if not data:
        return 0, False, 0, 0
    found = events(data)
    begin = np.concatenate([[0], np.flatnonzero(found & _CHANGE)])  # of each gap
    size = np.diff(begin, append=len(data))
    first = 97 <= data[0] | 32 <= 122
    letters = (np.arange(len(begin)) & 1 == 0) == first  # gaps take turns
    before = np.concatenate([[0], np.cumsum(np.where(letters, 1, size))])  # tokens before each gap
    n = int(before[-1])
    at = []
    for rank in sorted((low % (n + 1), high % (n + 1))):
        gap = int(np.searchsorted(before, rank, "right")) - 1
        at.append(len(data) if gap == len(begin) else int(begin[gap] + (0 if letters[gap] else rank - before[gap])))
    return n, bool((found & _SENTINEL).any()), *at


def _cut_column(text: Column, low: Column, high: Column) -> Column:
    def run(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = list(map(cut, texts, lows, highs))
        return pd.DataFrame(rows, columns=["n", "marked", "a", "b"])

    return F.pandas_udf(run, _COLUMNS)(text, low, high)


def _draw(doc: Column, group: int) -> Column:
    """One of the four numbers that a document's id gives."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row of (``doc_id``, ``text``).

    Null texts are empty. Empty texts, texts with a sentinel, and a tenth of the others stay as they are (form ``plain``, no lengths).
    A row without an id is drawn by the empty id; rows of one id are drawn alike, each cut by its own text. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({f"h{i}": _draw(F.col("doc_id"), i) for i in (1, 2, 3, 4)})
    rows = rows.withColumn("cut", _cut_column(F.col("text"), F.col("h1"), F.col("h2")))
    plain = (F.col("text") == "") | F.col("cut.marked") | (F.col("h3") % 100 >= TRANSFORMED)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < SUFFIX_FIRST, SPM).otherwise(PSM)
    n, a, b = F.col("cut.n"), F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    part = lambda start, size: F.substring("text", start + 1, size)
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.length("text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    out = rows.withColumn("form", form)
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    chars = lambda c: F.when(F.col("form") != PLAIN, c.cast("long"))
    return out.select("doc_id", n.alias("n"), "form", chars(a).alias("prefix_chars"), chars(b - a).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form: each sentinel's first place is its own, since transformed texts hold none."""
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    after = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM d),
  r AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM t),
  p AS (SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED} THEN '{PLAIN}'
             WHEN h4 % 100 < {SUFFIX_FIRST} THEN '{SPM}' ELSE '{PSM}' END AS form FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> '{PLAIN}' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> '{PLAIN}' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN '{PLAIN}' THEN text WHEN '{PSM}' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

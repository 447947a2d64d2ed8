"""Chat formatting with loss masks from offsets.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of the turns that carry loss
are intersected with the token spans by binary search.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each turn. The three marks are single special tokens, so no
token crosses the border of a turn's text. In roles and texts every ``<``, backslashes, ``|`` gets one more backslash, so
no mark can occur there, and taking one backslash away restores the text.

Defined results: rows of a conversation are ordered by turn (null first), then role, then text; null role and null text
are empty; rows with a null ``conv_id`` form one conversation; repeated rows are repeated turns; an empty table gives no
rows; other columns are ignored, whatever their names; any long is an id. Memory is bounded by the longest conversation: it is one
row of the result, so that of all rows without an id is one as well.

The tokenizer is a file that every executor can read at the same path; ``format_conversations`` raises where it is missing.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = (
    "conv_id long, none boolean, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"
)
_TOKENIZERS: dict[str, object] = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the texts of ``loss_role``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with one of the sorted, disjoint spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    left, right = np.array(spans).T
    k = np.searchsorted(right, starts, side="right")  # the first span that ends after the token starts
    return (k < len(left)) & (left[np.minimum(k, len(left) - 1)] < ends)


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, processors

        if not os.path.isfile(path):
            raise FileNotFoundError(f"no tokenizer at {path}: name the path of a byte-level BPE file that every executor can read")

        tok = Tokenizer.from_file(path)
        open_ = [t.content for t in tok.get_added_tokens_decoder().values() if "<|" not in t.content]
        if open_:  # a text that holds one would turn into it: only what has <| is escaped
            raise ValueError(f"the tokenizer at {path} has tokens of its own that texts can spell: {open_[:5]}")
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        tok.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
        _TOKENIZERS[path] = tok
    return _TOKENIZERS[path]


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, bool], list[tuple[str, str]]]]:
    """Conversations of a partition that is sorted by conversation; they may go on over several batches."""
    key, turns = None, []
    for pdf in batches:
        for cid, none, role, text in zip(pdf["conv_id"], pdf["none"], pdf["role"], pdf["text"], strict=True):
            if (cid, none) != key:
                if key is not None:
                    yield key, turns
                key, turns = (cid, none), []
            turns.append((role, text))
    if key is not None:
        yield key, turns


def format_conversations(
    conversations: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, loss_role: str = "assistant", partitions: int | None = None
) -> DataFrame:
    """One row per conversation: formatted text, token ids, token offsets in code points, loss mask.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, rows, size = _tokenizer(tokenizer), [], 0

        def flush() -> pd.DataFrame:
            encoded = tok.encode_batch([r[1] for r in rows], add_special_tokens=False)
            out = []
            for (cid, text, spans), e in zip(rows, encoded, strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                out.append((*cid, text, e.ids, offsets[:, 0], offsets[:, 1], token_mask(offsets[:, 0], offsets[:, 1], spans)))
            return pd.DataFrame(out, columns=["conv_id", "none", "formatted", "input_ids", "token_start", "token_end", "loss_mask"])

        for cid, turns in _conversations(batches):
            text, spans = render(turns, loss_role)
            rows.append((cid, text, spans))
            size += len(text)
            if size > 1_000_000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    keyed = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("conv_id").isNull().alias("none"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = keyed.repartition(partitions, "conv_id", "none") if partitions else keyed.repartition("conv_id", "none")
    return _with_ids(dealt.sortWithinPartitions("conv_id", "none", "turn", "role", "text").mapInPandas(run, SCHEMA))


def _with_ids(rows: DataFrame) -> DataFrame:
    """Ids that can be null go to the workers with a flag: as floats they would lose digits."""
    return rows.withColumn("conv_id", F.when(~F.col("none"), F.col("conv_id"))).drop("none")


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts under the loss mask: one for each run of masked tokens."""
    on = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(on[::2], on[1::2], strict=True)]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but the formatted text, the offsets and the mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, none, text, starts, ends, mask in pdf.itertuples(index=False):
                turns, all_turns = parse(text), hashlib.sha256()
                for role, body in turns:
                    all_turns.update(f"{role}\n{body}\n".encode())
                loss = "".join(masked_texts(text, np.asarray(starts), np.asarray(ends), np.asarray(mask, bool)))
                rows.append((cid, none, len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "none", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ident = [F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none")]
    found = formatted.select(*ident, "formatted", "token_start", "token_end", "loss_mask").mapInPandas(
        run, "conv_id long, none boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return _with_ids(found)


def oracle(case: str) -> str:
    """Digests in DuckDB's SQL, from the rows themselves; ``case``: the text of conversation -1."""
    extra = lambda c: f"len(regexp_extract_all({c}, '<\\\\*\\|'))"  # marks that get one more backslash
    fixed = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{case}' UNION ALL SELECT -1, 1, 'assistant', '{case}')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({fixed} + length(role) + length(text) + {extra("role")} + {extra("text")})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""

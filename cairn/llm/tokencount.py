"""Token counts of fields and sections from one encoding of the whole text.

A text is encoded once. Tokens tile its bytes, sections tile its bytes too, and an interval join of the two (a search
of each token's span in the sections' sorted bounds) gives each token to one section. A token that crosses a border
goes by an explicit rule: "start" to the section of its first byte, "end" to that of its last byte, "majority" to the
one that holds most of its bytes, the earlier on a tie. So the counts of a text's sections add up to its tokens.

Defined cases: null text is the empty text and has one section without tokens; sections are lines with their newline,
and a text that ends in a newline has no empty last line; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import codec, vocabulary
from cairn.llm.common import map_documents, narrow, read_table, text_or_empty

RULES = ("start", "end", "majority")


def token_bounds(packed: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of tokens: starts and ends."""
    ends = np.cumsum(lengths[np.frombuffer(packed, dtype="<u4")])
    return np.concatenate([np.zeros(min(1, len(ends)), dtype=ends.dtype), ends[:-1]]), ends


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens in each section; `sections` are the sections' end bytes, ascending, the last the text's length."""
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, ends - 1, side="right")
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    elif rule == "majority":
        owner = first.copy()
        for k in np.flatnonzero(last > first):
            inner = sections[first[k] : last[k]]
            shares = np.diff(np.concatenate([[starts[k]], inner, [ends[k]]]))
            owner[k] = first[k] + int(np.argmax(shares))
    else:
        raise ValueError(f"unknown rule: {rule}")
    return np.bincount(owner, minlength=len(sections))[: len(sections)]


def lines(text: str) -> list[str]:
    """Lines with their newline."""
    found = [x + "\n" for x in text.split("\n")]
    found[-1] = found[-1][:-1]
    return found if found[-1] or len(found) == 1 else found[:-1]


_lengths: dict[str, np.ndarray] = {}


def _token_lengths(path: str, pattern: str) -> np.ndarray:
    if path not in _lengths:
        _lengths[path] = np.array([len(b) for b in codec(path, pattern).bytes_of], dtype=np.int64)
    return _lengths[path]


def counted(text: str, sections: list[str], path: str, pattern: str, rule: str) -> list[int]:
    """Tokens of each of `sections`, which joined are `text`."""
    packed = codec(path, pattern).encode(text)
    bounds = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in sections])
    if not packed:
        return [0] * len(sections)
    starts, ends = token_bounds(packed, _token_lengths(path, pattern))
    return attribute(starts, ends, bounds, rule).tolist()


def count_sections(docs: DataFrame, path: str, pattern: str, rule: str = "majority", split=lines) -> DataFrame:
    """A row for each section: doc_id, section (from 0), start and end in code points, n_tokens, and the text's n_tokens."""

    def run(columns):
        out = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens", "doc_tokens")}
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            sections = split(text)
            counts = counted(text, sections, path, pattern, rule)
            ends = np.cumsum([len(s) for s in sections])
            out["doc_id"] += [doc_id] * len(sections)
            out["section"] += range(len(sections))
            out["start"] += [0, *ends[:-1].tolist()]
            out["end"] += ends.tolist()
            out["n_tokens"] += counts
            out["doc_tokens"] += [sum(counts)] * len(sections)
        return out

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_documents(rows, run, "doc_id long, section long, start long, end long, n_tokens long, doc_tokens long")


def count_fields(df: DataFrame, key: str, fields: list[str], path: str, pattern: str, rule: str = "majority", separator: str = "\n") -> DataFrame:
    """key, field, n_tokens: the fields joined by `separator` are encoded once; a separator belongs to the field before it."""

    def run(columns):
        out = {"key": [], "field": [], "n_tokens": []}
        for i, k in enumerate(columns["key"]):
            sections = [(columns[f"f{j}"][i] or "") + separator * (j + 1 < len(fields)) for j in range(len(fields))]
            out["key"] += [k] * len(fields)
            out["field"] += fields
            out["n_tokens"] += counted("".join(sections), sections, path, pattern, rule)
        return out

    rows = narrow(df, key, *fields).toDF("key", *(f"f{j}" for j in range(len(fields)))).withColumn("key", F.col("key").cast("string"))
    return map_documents(rows, run, "key string, field string, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_sections(read_table(spark, sf_dir, "documents"), *vocabulary())

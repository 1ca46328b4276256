"""Token counts of fields and sections by offset-mapped attribution.

A document, its fields one after the other as they are trained on, is encoded
once as a whole.  Its tokens' character spans are joined with the spans of its
fields and sections (sorted intervals, searched within the document).  Nothing
stands between fields, so a token may begin in one and end in the next; such a
token goes to one of them by rule:

    "largest"  the section that holds most of its characters, the earlier of equals
    "first"    the section that holds its first character
    "last"     the section that holds its last character

Every token that overlaps a section is counted exactly once.

Defined results: null text counts as empty; a text without characters has one
empty section with no tokens; null lang or source is an empty field; blank
lines are sections with no tokens; repeated rows are counted apart; a very long
text is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .tokens import default_tokenizer
from .tokens import spans as encoded_spans

RULE = "largest"
RESULT = "doc_id long, section int, field string, start long, end long, n_tokens long, n_crossing long"


def attribute(lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross into another section) of each section.

    lo, hi: token spans, ascending; starts, ends: disjoint section spans, ascending.
    """
    n = len(starts)
    first = np.searchsorted(ends, lo, side="right")
    last = np.searchsorted(starts, hi, side="left") - 1
    held = first <= last
    lo, hi, first, last = lo[held], hi[held], first[held], last[held]
    if rule == "first":
        own = first
    elif rule == "last":
        own = last
    else:
        own = first.copy()
        for t in np.flatnonzero(last > first).tolist():
            span = np.arange(first[t], last[t] + 1)
            own[t] = span[np.argmax(np.minimum(ends[span], hi[t]) - np.maximum(starts[span], lo[t]))]
    return np.bincount(own, minlength=n), np.bincount(own[last > first], minlength=n)


def laid_out(source: str, lang: str, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The whole document as it is trained on, its fields side by side, and their spans; the text by lines."""
    head = source + lang
    spans = [("source", 0, len(source)), ("lang", len(source), len(head))]
    at = len(head)
    for line in text.split("\n"):
        spans.append(("text", at, at + len(line)))
        at += len(line) + 1
    return head + text, spans


def counts(docs: DataFrame, tokenizer: str | None = None, rule: str = RULE) -> DataFrame:
    """RESULT: one row per field or line of each document (doc_id, text, lang, source)."""
    path = tokenizer or default_tokenizer()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                document, spans = laid_out(source or "", lang or "", text or "")
                lo, hi = encoded_spans(document, path).T
                starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (1, 2))
                n, crossing = attribute(lo, hi, starts, ends, rule)
                rows[0] += [doc_id] * len(spans)
                rows[1] += range(len(spans))
                rows[2] += [s[0] for s in spans]
                for column, x in zip(rows[3:], (starts, ends, n, crossing), strict=True):
                    column.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), *(pa.array(np.concatenate(x), pa.int64()) for x in rows[3:])], names=["doc_id", "section", "field", "start", "end", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(step, RESULT)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))

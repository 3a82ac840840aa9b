"""Documents as keys, and spans joined back to their documents.

A document's key is its doc_id (null counts as the largest) and a hash of its
text, so that different rows with one doc_id stay apart. The key depends on the
row alone, not on where it lies, and survives recomputation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "doc long, mark int"
SPAN = f"{KEY}, lo int, hi int"
LAST = (1 << 63) - 1


def pack(mark: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """mark and lo in one long, in their order; rows in text order then differ in few bytes, which packs well."""
    return (mark.astype(np.int64) << 32) | lo.astype(np.int64)


def unpacked(place: str):
    return F.shiftright(place, 32).cast("int"), F.col(place).bitwiseAND(0xFFFFFFFF).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, mark, text) of all rows."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), F.hash(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def text_bytes(df: DataFrame) -> float:
    return float(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def runs(doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Join touching or overlapping spans of a document. The input may be in any order."""
    if not len(doc):
        return doc, mark, lo, hi
    order = np.lexsort((hi, lo, mark, doc))
    doc, mark, lo, hi = doc[order], mark[order], lo[order], hi[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    # running maximum of hi within a document: shift each document above the former
    base = np.cumsum(fresh) * (int(hi.max()) + 1)
    top = np.maximum.accumulate(hi + base) - base
    head = fresh.copy()
    head[1:] |= lo[1:] > top[:-1]
    at = np.flatnonzero(head)
    return doc[at], mark[at], lo[at], top[np.concatenate([at[1:] - 1, [len(doc) - 1]])]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: the list of [lo, hi) of each document, null for none. A list is bounded by its document's length.

    The keys have names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in taken else free(f"{name}_")
    ours, theirs = (free("_doc"), free("_mark")), (free("_found_doc"), free("_found_mark"))
    lists = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumnsRenamed(dict(zip(("doc", "mark"), theirs, strict=True)))
    own = docs.drop(*[c for c in docs.columns if c.lower() == "spans"]).withColumns({ours[0]: F.coalesce("doc_id", F.lit(LAST)).cast("long"), ours[1]: F.hash(F.coalesce("text", F.lit("")))})
    return own.join(lists, (F.col(ours[0]) == F.col(theirs[0])) & (F.col(ours[1]) == F.col(theirs[1])), "left").drop(*ours, *theirs)


def span_lists(column: pa.Array):
    """(offsets, lo, hi) of a list<struct<lo, hi>> column."""
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the n units that some span covers."""
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0

"""Substring dedup on words: remove what a window of an earlier place already says.

A window is ``window`` consecutive words of one document. It is removed where
the same words start earlier: in a document of smaller doc_id, or earlier in the
same document. Two passes over the texts:

1. Each partition sketches its windows, partitions' sketches are merged
   (:mod:`.sketch`) and overestimate how often a window occurs. A window is
   counted through its anchors: in each stretch of ``reach`` words the ``gram``
   words with the smallest hash. Equal windows have equal anchors, so no anchor's
   count is below the window's, and neighbouring windows share them. The
   estimate of a window is the least of its anchors'.
2. Windows estimated to occur twice or more are grouped exactly, by 93 bits of
   fingerprints of their words' fingerprints, whose bases are drawn for each query;
   all others are unique and are never shuffled. A partition sends a
   window once, with its earliest place in the partition; later places there
   are settled at once. So no group exceeds the number of partitions, however
   common a passage is.

Nulls and oddities: a null or empty text has no words; a null doc_id counts as
the largest; rows that share a doc_id but not the text are ordered by a hash of
the text; repeated rows (doc_id and text) are one document and get one result
each; texts shorter than a window are kept whole. An empty table gives an empty
result. Columns named like the operator's own are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sketch
from .common import BASES, BYTE_VALUES, Fingerprint, RangeHash, fresh_bases, mix, only, slices, word_bounds
from .spans import covered, keyed, pack, runs, span_lists, text_bytes, unpacked, with_spans

_POSITION = np.uint64((1 << 30) - 1)
NAMES = ["doc", "place", "one", "two", "settled"]
FLUSH = 3 << 18


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class WordWindows:
    """Windows of a piece of texts: first word of each, and the anchors of its stretches. ``bases``: of fingerprints of bytes and words, twice."""

    def __init__(self, window: int, reach: int, gram: int, bases: list[int] | None = None):
        self.window, self.reach, self.gram = window, reach, gram
        self.bytes_, self.words = RangeHash(BASES[0]), RangeHash(BASES[0])
        self.prints = [(Fingerprint(a), Fingerprint(b)) for a, b in zip(bases[::2], bases[1::2], strict=True)] if bases else []

    def of(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_bounds(data, offsets)
        n = len(starts)
        if n < self.window:
            return None
        words = self.bytes_.of(self.bytes_.prefix(BYTE_VALUES[0][data]), starts, ends)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(text[self.window - 1 :] == text[: n - self.window + 1])
        if not len(at):
            return None
        prefix = self.words.prefix(words)
        i = np.arange(n - self.gram + 1)
        grams = self.words.of(prefix, i, i + self.gram)
        packed = (grams & ~_POSITION) | i.astype(np.uint64)
        anchor = (sliding_min(packed, self.reach - self.gram + 1) & _POSITION).astype(np.int64)
        # a stretch across two texts belongs to no window
        inside = np.flatnonzero(text[self.reach - 1 :] == text[: n - self.reach + 1])
        own = anchor[inside]
        fresh = np.concatenate([[True], own[1:] != own[:-1]])
        number = np.zeros(len(anchor), np.int64)
        number[inside] = np.cumsum(fresh) - 1
        return {"at": at, "text": text, "first": first, "starts": starts, "ends": ends, "anchors": grams[own[fresh]], "number": number}

    def repeated(self, w: dict, anchors: np.ndarray) -> np.ndarray:
        """First words of the windows all of whose anchors are marked."""
        odd = np.concatenate([[0], np.cumsum(~anchors[w["number"]])])
        return w["at"][odd[w["at"] + self.window - self.reach + 1] == odd[w["at"]]]

    def hashes(self, w: dict, data: np.ndarray, offsets: np.ndarray, at: np.ndarray):
        """Two fingerprints of the windows that start at some words, from the texts that hold these."""
        texts = np.unique(w["text"][at])
        data, moved = only(data, offsets, texts)
        chosen = np.zeros(len(offsets) - 1, bool)
        chosen[texts] = True
        words = np.flatnonzero(chosen[w["text"]])
        shift = moved[w["text"][words]]
        number = np.zeros(len(w["text"]), np.int64)
        number[words] = np.arange(len(words))
        at, out = number[at], []
        for bytes_, words_ in self.prints:
            each = bytes_.of(bytes_.prefix(data), w["starts"][words] + shift, w["ends"][words] + shift)
            out.append(words_.of(words_.prefix(each), at, at + self.window))
        return out


def _sketcher(bits: int, shape: tuple):
    def run(batches):
        kernel, local = WordWindows(*shape), sketch.LocalSketch(bits)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                if w := kernel.of(data, offsets):
                    local.add(w["anchors"])
                    if local.n > sketch.FLUSH:
                        yield from local.rows()
        yield from local.rows()

    return run


def _settle(found: list, window: int):
    """Of a partition's candidate places: the earliest of each window to be sent on in text order, the rest as joined
    spans, which have a first hash of their own and their end for the second."""
    doc, mark, start, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
    two = (two & np.uint64(0xFFFFFFFF)) << np.uint64(32)  # 32 of its bits are sent
    order = np.lexsort((start, mark, doc, two, one))
    head = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    lead = order[head][np.cumsum(head) - 1]
    later = order[(doc[order] != doc[lead]) | (mark[order] != mark[lead]) | (start[order] != start[lead])]
    d, m, lo, hi = runs(doc[later], mark[later], start[later].astype(np.int64), start[later].astype(np.int64) + window)
    place = pack(m, lo)
    own = mix(d.view(np.uint64) ^ mix(place.view(np.uint64)))
    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(place), pa.array(own.view(np.int64)), pa.array(hi.astype(np.int32)), pa.array(np.ones(len(d), bool))], names=NAMES)
    at = np.sort(order[head])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], pack(mark[at], start[at]), one[at].view(np.int64), (two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.zeros(len(at), bool))], names=NAMES)


def _finder(whole, bits: int, shape: tuple, bases: list[int]):
    window = shape[0]

    def run(batches):
        kernel, found, n = WordWindows(*shape, bases), [], 0
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for top, _, data, offsets in slices(batch.column(2)):
                if not (w := kernel.of(data, offsets)):
                    continue
                at = kernel.repeated(w, sketch.repeated(whole.value, bits, w["anchors"]))
                if len(at):
                    text = w["text"][at]
                    one, two = kernel.hashes(w, data, offsets, at)
                    found.append((docs[top + text], marks[top + text], (at - w["first"][text]).astype(np.int32), one, two))
                    n += len(at)
                    if n > FLUSH:
                        yield from _settle(found, window)
                        found, n = [], 0
        if n:
            yield from _settle(found, window)

    return run


def repeated_spans(docs: DataFrame, window: int = 20, reach: int = 14, gram: int = 10) -> DataFrame:
    """(doc, mark, lo, hi): word spans of windows that also start earlier. They may overlap."""
    texts, shape = keyed(docs), (window, reach, gram)
    bits = sketch.bits_for(text_bytes(texts) / 6 * 2 / (reach - gram + 2))
    whole = sketch.merged(texts.select("text").mapInArrow(_sketcher(bits, shape), sketch.SCHEMA), bits)
    found = texts.mapInArrow(_finder(whole, bits, shape, fresh_bases(4)), "doc long, place long, one long, two int, settled boolean")
    here = F.struct("doc", "place")
    first = F.min(here).over(Window.partitionBy("one", "two"))
    later = found.withColumn("first", first).where(F.col("settled") | (here != F.col("first")))
    mark, lo = unpacked("place")
    return later.select("doc", mark.alias("mark"), lo.alias("lo"), F.when(F.col("settled"), F.col("two")).otherwise(lo + window).alias("hi"))


def _keep(batches):
    for batch in batches:
        cuts, lo, hi = span_lists(batch.column("spans"))
        kept, words, gone = [], [], []
        for i, text in enumerate(batch.column("text")):
            own = text.as_py().encode().split() if text.is_valid else []
            n = len(own)
            if cuts[i + 1] > cuts[i]:
                mask = covered(n, lo[cuts[i] : cuts[i + 1]], hi[cuts[i] : cuts[i + 1]])
                own = [own[j] for j in np.flatnonzero(~mask)]
            kept.append(b" ".join(own))
            words.append(n)
            gone.append(n - len(own))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names, "kept_text", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame, window: int = 20, reach: int = 14, gram: int = 10) -> DataFrame:
    """``docs`` with ``spans`` (word spans [lo, hi) to remove), ``kept_text`` (kept words, one space between), ``n_words`` and ``n_removed``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("spans", "kept_text", "n_words", "n_removed")])
    joined = with_spans(docs, repeated_spans(docs, window, reach, gram))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.mapInArrow(_keep, f"{schema}, kept_text string, n_words long, n_removed long")


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))

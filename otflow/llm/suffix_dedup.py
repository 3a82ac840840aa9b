"""Suffix-array dedup on bytes: remove strings of threshold length that occur twice.

Suffixes are ordered only through the first ``length`` bytes, by passes over
digits, the most significant first; suffixes alone in their group leave after
each pass, and the groups that are equal to the full depth are exactly the
repeated strings. Neighbouring suffixes are taken together as runs, so that a
pass moves one row for about forty suffixes.

1. First digit, cut by content: in each stretch of ``reach`` bytes the ``gram``-byte
   string with the smallest hash is an anchor, and a suffix's digit is what lies
   between its first anchor and its last. All suffixes between the same two
   anchors form one run. A merged count-min sketch drops runs whose digit occurs
   once in the table.
2. Each partition orders its remaining runs by length, first digit and then their
   bytes, ``DIGIT`` at a time from the front: every pass splits the groups by the
   next digit and drops those of one run (:func:`radix_groups`). Groups that are
   left at the runs' ends are equal strings; they are settled here, and one row
   speaks for each, as for each run that was alone.
3. Rows of all partitions meet by a last digit that stands for all their bytes: two
   fingerprints modulo 2**61 - 1 with bases drawn for each query.
4. Where a first digit has several last ones, some of them alone (runs at the ends
   of a copied passage), their suffixes are told apart one by one, by the same
   passes over all ``length`` bytes.

No group exceeds the number of partitions, as each partition settles its own
repeats.

Nulls and oddities: a null text is an empty one; texts shorter than ``length``
are kept whole; rows are documents even if repeated, so repeated long rows lose
all their bytes; rows sharing doc_id are told apart by a hash of their texts. An
empty table gives an empty result. Columns named like the operator's own are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sketch
from .common import BASES, BYTE_VALUES, Fingerprint, RangeHash, fresh_bases, materialise, mix, only, ranges, slices
from .spans import covered, keyed, pack, runs, span_lists, text_bytes, unpacked, with_spans
from .substring_dedup import sliding_min

_POSITION = np.uint64((1 << 30) - 1)
FLUSH, HELD = 3 << 17, 1 << 23
DIGIT = 8
#: meta: length of the span, a bit for settled ones, count.
RUN = "doc long, place long, core long, one long, two long, meta long"
SETTLED = 4


class SuffixRuns:
    """Runs of suffixes of a piece of texts. ``bases``: of the two fingerprints."""

    def __init__(self, length: int, reach: int, gram: int, bases: list[int] | None = None):
        self.length, self.reach, self.gram = length, reach, gram
        self.one, self.prints = RangeHash(BASES[0]), [Fingerprint(b) for b in bases or ()]

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """Runs of suffixes: text, first and last start (in the piece), and the hash of their first digit."""
        n, length = len(data), self.length
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes >= length)
        if not len(long):
            return None
        one = self.one.prefix(BYTE_VALUES[0][data])
        i = np.arange(n - self.gram + 1)
        packed = (self.one.of(one, i, i + self.gram) & ~_POSITION) | i.astype(np.uint64)
        anchor = (sliding_min(packed, self.reach - self.gram + 1) & _POSITION).astype(np.int64)
        counts = sizes[long] - length + 1
        text = np.repeat(long, counts)
        at = np.arange(counts.sum()) + np.repeat(offsets[long] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        first, last = anchor[at], anchor[at + (length - self.reach)]
        head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (text[1:] != text[:-1])]))
        tail = np.concatenate([head[1:], [len(at)]]) - 1
        return {"text": text[head], "lo": at[head], "hi": at[tail], "core": self.one.of(one, first[head], last[head] + self.gram), "one": one}

    def last_digits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [f.of(f.prefix(data), start, end) for f in self.prints]


def radix_groups(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings that occur twice or more, ordered: their numbers, group by group, and the number of each one's group.

    The digits are a string's size, its ``first`` digit, and then its bytes from the front, ``DIGIT`` at a time; strings
    alone in their group leave after each pass. Strings hold ``DIGIT`` bytes at least."""
    at = np.lexsort((first, size))
    done, groups, n_groups = [], [], 0
    key = (size[at], first[at])
    head = np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
    wide = np.ndarray(max(0, len(data) - DIGIT + 1), ">u8", data, strides=(1,)) if len(data) >= DIGIT else np.zeros(0, ">u8")
    depth = 0
    while len(at):
        group = np.cumsum(head) - 1
        stay = np.bincount(group)[group] > 1
        at, head = at[stay], head[stay]
        ended = size[at] <= depth
        if ended.any():  # a group's strings have one size and end together
            done.append(at[ended])
            groups.append(np.cumsum(head[ended]) - 1 + n_groups)
            n_groups += int(head[ended].sum())
            at, head = at[~ended], head[~ended]
        if not len(at):
            break
        # the last digit of a string may overlap the one before
        digit = wide[start[at] + np.minimum(depth, size[at] - DIGIT)]
        group = np.cumsum(head) - 1
        if (digit != digit[np.flatnonzero(head)][group]).any():
            order = np.lexsort((digit, group))
            at, digit, group = at[order], digit[order], group[order]
            head = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        depth += DIGIT
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done), np.concatenate(groups)


class Found:
    """A partition's strings until they are settled: places, last digits, and the bytes of the texts they lie in."""

    def __init__(self):
        self.rows, self.texts, self.n, self.held = [], [], 0, 0

    def add(self, data: np.ndarray, doc, mark, lo, hi, core, start, digits) -> None:
        self.rows.append((doc, mark, lo.astype(np.int32), hi.astype(np.int32), core, start + self.held, *digits))
        self.texts.append(data)
        self.n += len(doc)
        self.held += len(data)

    def settled(self, least: int = FLUSH, held: int = HELD):
        """Each string once with its count (to two); those that occur twice here also as joined spans, under keys of their
        own and with a count of two. Rows are sent in text order, which packs well. Nothing yet where no more than
        ``least`` strings and ``held`` bytes are there."""
        if not self.n or (self.n <= least and self.held <= held):
            return
        doc, mark, lo, hi, core, start, one, two = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        data = np.concatenate(self.texts)
        self.__init__()
        twice, group = radix_groups(data, start, (hi - lo).astype(np.int64), core)
        d, m, a, b = runs(doc[twice], mark[twice], lo[twice].astype(np.int64), hi[twice].astype(np.int64))
        own = mix(d.view(np.uint64) ^ mix(a.view(np.uint64) ^ m.astype(np.uint64)))
        yield _batch(d, m, a, b, np.zeros(len(d), np.uint64), own, mix(~own), np.full(len(d), SETTLED | 2))
        count = np.ones(len(doc), np.int64)
        count[twice] = 0
        count[twice[np.concatenate([[True], group[1:] != group[:-1]])] if len(twice) else twice] = 2
        at = np.flatnonzero(count)
        yield _batch(doc[at], mark[at], lo[at], hi[at], core[at], one[at], two[at], count[at])


def _sketcher(bits: int, shape: tuple):
    def run(batches):
        kernel, local = SuffixRuns(*shape), sketch.LocalSketch(bits)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                if r := kernel.of(data, offsets):
                    local.add(r["core"])
                    if local.n > sketch.FLUSH:
                        yield from local.rows()
        yield from local.rows()

    return run


def _batch(doc, mark, lo, hi, core, one, two, n) -> pa.RecordBatch:
    meta = ((hi.astype(np.int64) - lo) << 3) | n
    rows = [doc, pack(mark, lo), core.view(np.int64), one.view(np.int64), two.view(np.int64), meta]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["doc", "place", "core", "one", "two", "meta"])


def _opened() -> list:
    mark, lo = unpacked("place")
    return ["doc", mark.alias("mark"), lo.alias("lo"), (lo + F.shiftright("meta", 3).cast("int")).alias("hi")]


def _runs_finder(whole, bits: int, shape: tuple, bases: list[int]):
    def run(batches):
        kernel, found = SuffixRuns(*shape, bases), Found()
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for top, _, data, offsets in slices(batch.column(2)):
                if not (r := kernel.of(data, offsets)):
                    continue
                at = np.flatnonzero(sketch.repeated(whole.value, bits, r["core"]))
                if len(at):
                    text, lo, hi = r["text"][at], r["lo"][at], r["hi"][at] + kernel.length
                    own, moved = only(data, offsets, np.unique(text))
                    digits = kernel.last_digits(own, lo + moved[text], hi + moved[text])
                    found.add(own, docs[top + text], marks[top + text], lo - offsets[text], hi - offsets[text], r["core"][at], lo + moved[text], digits)
                    yield from found.settled()
        yield from found.settled(0, 0)

    return run


def _suffix_finder(open_cores, bits: int, shape: tuple, bases: list[int]):
    """Single suffixes of runs whose first digit is open; of equal runs in a partition, one speaks for all."""

    def run(batches):
        kernel, found, seen = SuffixRuns(*shape, bases), Found(), set()
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for top, _, data, offsets in slices(batch.column(2)):
                if not (r := kernel.of(data, offsets)):
                    continue
                at = np.flatnonzero(sketch.repeated(open_cores.value, bits, r["core"]))
                if not len(at):
                    continue
                own, moved = only(data, offsets, np.unique(r["text"][at]))
                shift = moved[r["text"][at]]
                keys = kernel.last_digits(own, r["lo"][at] + shift, r["hi"][at] + kernel.length + shift)
                fresh = [k not in seen and not seen.add(k) for k in zip(*(k.tolist() for k in keys), strict=True)]
                at = at[np.array(fresh, bool)]
                if not len(at):
                    continue
                sizes = r["hi"][at] - r["lo"][at] + 1
                text, start = np.repeat(r["text"][at], sizes), ranges(r["lo"][at], sizes)
                here = start + moved[text]
                digits = kernel.last_digits(own, here, here + kernel.length)
                lo = start - offsets[text]
                found.add(own, docs[top + text], marks[top + text], lo, lo + kernel.length, np.zeros(len(lo), np.uint64), here, digits)
                yield from found.settled()
                if len(seen) > FLUSH:
                    seen.clear()
        yield from found.settled(0, 0)

    return run


def _core_bits(bits: int):
    def run(batches):
        local = sketch.LocalSketch(bits)
        for batch in batches:
            local.add(batch.column(0).to_numpy().view(np.uint64))
            if local.n > sketch.FLUSH:
                yield from local.rows(twice=True)
        yield from local.rows(twice=True)

    return run


def repeated_spans(docs: DataFrame, length: int = 400, reach: int = 96, gram: int = 24) -> DataFrame:
    """(doc, mark, lo, hi): byte spans whose every ``length`` bytes occur elsewhere. They may overlap."""
    texts, shape, bases = keyed(docs), (length, reach, gram), fresh_bases(2)
    size = text_bytes(texts)
    bits = sketch.bits_for(size * 4 / (reach - gram + 2))
    whole = sketch.merged(texts.select("text").mapInArrow(_sketcher(bits, shape), sketch.SCHEMA), bits)
    found = texts.mapInArrow(_runs_finder(whole, bits, shape, bases), RUN)
    total = F.sum(F.col("meta").bitwiseAND(3)).over(Window.partitionBy("one", "two"))
    judged = materialise(found.select("doc", "place", "meta", "core", F.col("one").alias("digit"), (total >= 2).alias("equal")))
    cores = judged.where(F.col("meta").bitwiseAND(SETTLED) == 0).groupBy("core").agg(F.min("digit").alias("a"), F.max("digit").alias("b"), F.min("equal").alias("all_equal")).where("a <> b and not all_equal").select("core")
    core_bits = sketch.bits_for(size / 400)
    open_cores = sketch.merged(cores.mapInArrow(_core_bits(core_bits), sketch.SCHEMA), core_bits)
    single = texts.mapInArrow(_suffix_finder(open_cores, core_bits, shape, bases), RUN)
    matched = single.withColumn("total", total).where("total >= 2")
    return judged.where("equal").select(*_opened()).unionByName(matched.select(*_opened()))


def _keep(batches):
    for batch in batches:
        cuts, lo, hi = span_lists(batch.column("spans"))
        kept, removed, sizes, gone = [], [], [], []
        for i, text in enumerate(batch.column("text")):
            own = text.as_py().encode() if text.is_valid else b""
            found = []
            if cuts[i + 1] > cuts[i]:
                mask = covered(len(own), lo[cuts[i] : cuts[i + 1]], hi[cuts[i] : cuts[i + 1]])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                found = [{"lo": int(a), "hi": int(b)} for a, b in edge.reshape(-1, 2)]
                sizes.append(len(own))
                own = np.frombuffer(own, np.uint8)[~mask].tobytes()
            else:
                sizes.append(len(own))
            removed.append(found)
            kept.append(own)
            gone.append(sizes[-1] - len(own))
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        names = [c for c in batch.schema.names if c != "spans"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(removed, span), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "spans", "kept", "n_bytes", "n_removed"])


def dedup_suffixes(docs: DataFrame, length: int = 400, **shape) -> DataFrame:
    """``docs`` with ``spans`` (maximal removed byte runs [lo, hi)), ``kept`` (remaining bytes), ``n_bytes`` and ``n_removed``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("spans", "kept", "n_bytes", "n_removed")])
    joined = with_spans(docs, repeated_spans(docs, length, **shape))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "spans")
    return joined.mapInArrow(_keep, f"{schema}, spans array<struct<lo:int,hi:int>>, kept binary, n_bytes long, n_removed long")


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_suffixes(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))

"""Phrase collocation mining by SON partitioning, exact at any size.

The documents are dealt into shards by a hash of doc_id. A phrase with ``support``
occurrences in a language has, in at least one shard, its share of them by the
shard's share of all words: so each shard is mined completely at that lowered
support, and the union of what is frequent in a shard misses nothing. There are
support / 2 shards, however large the corpus, so that the lowered support is about
two and drops phrases that occur once; a shard is spread over many tasks, which
send counts of 64-bit hashes. Equal hashes of different phrases only add
candidates.

A second pass counts all candidates exactly, as text: each task looks its phrases
up in a sketch of the candidates (two bits each, broadcast; ``sketch.MAX_BITS``
bounds it), or, with more than ``most`` candidates, their hashes are joined with
the candidates'. Both give the same rows. Tasks group by 125 bits, of which 61 are
a fingerprint with drawn bases, before the exchange groups by text.

Words: A-Z are lower-cased; a text is cut at ``.,;:!?`` and U+000A to U+000D into
pieces, these at space and tab into words. A null text is empty, a null lang is
``und``; doc_id only deals shards, so nulls and repeated ids are fine. Repeated rows
count as often as they stand there. No or only empty texts give no rows. Other
columns are ignored. Counts are longs; a*a*1000000 must stay below 10**38, so a
below 10**16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import BASES, BYTE_VALUES, Fingerprint, RangeHash, ascii_lower, fresh_bases, materialise, mix, ranges, slices, tidy

NO_LANG = "und"
#: Hashes that a task holds before it counts them.
FLUSH = 1 << 20
#: Candidates up to which their sketch is broadcast (two bits of up to 2**MAX_BITS cells each, a quarter full at most).
MOST = 1 << 28
#: Parts of a language's phrases that are ranked apart first.
PARTS = 64

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Phrases:
    """Phrases of 1 to ``most`` words of a slice of texts: keys, and what it takes to write them out."""

    def __init__(self, most: int, bases: list[int] | None = None):
        self.most, self.bytes_ = most, RangeHash(BASES[0])
        self.prints = [Fingerprint(b) for b in bases] if bases else None

    def of(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        """Bounds and text of each word; by length, the first word (``at``) and the key of all phrases."""
        self.data = data = ascii_lower(data)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        stop = _BREAK[data]
        solid = np.concatenate([[False], ~(stop | _GAP[data]), [False]])
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        piece = np.cumsum(stop | cut[:-1])[self.starts]
        words = mix(self.bytes_.of(self.bytes_.prefix(BYTE_VALUES[0][data]), self.starts, self.ends) ^ langs[self.text])
        key, at = words, np.arange(len(words))
        self.at, self.keys = [at], [key]
        for k in range(2, self.most + 1):
            room = int(np.searchsorted(at, len(words) - k + 1))
            on = np.flatnonzero(piece[at[:room] + k - 1] == piece[at[:room]])
            at, key = at[on], mix(key[on] * _STEP + words[at[on] + k - 1])
            self.at.append(at)
            self.keys.append(key)

    def second(self, langs: np.ndarray) -> list[np.ndarray]:
        """Fingerprints of the words of all phrases, language included, by length."""
        bytes_, words_ = self.prints
        prefix = words_.prefix(bytes_.of(bytes_.prefix(self.data), self.starts, self.ends))
        return [mix(words_.of(prefix, at, at + k) ^ mix(langs[self.text[at]] + np.uint64(k))) for k, at in enumerate(self.at, 1)]

    def written(self, at: np.ndarray, k: int) -> pa.Array:
        """Phrases of ``k`` words, a space between them."""
        word = (at[:, None] + np.arange(k)).ravel()
        sizes = self.ends[word] - self.starts[word]
        out = np.full(int(sizes.sum()) + len(word), 0x20, np.uint8)
        here = np.cumsum(sizes + 1) - sizes - 1
        out[ranges(here, sizes)] = self.data[ranges(self.starts[word], sizes)]
        cuts = np.concatenate([[0], np.cumsum((sizes + 1).reshape(-1, k).sum(1))]).astype(np.int64)
        keep = np.ones(len(out), bool)
        keep[cuts[1:] - 1] = False  # the space behind a phrase
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cuts - np.arange(len(cuts))), pa.py_buffer(out[keep])]).cast(pa.string())


def _texts(docs: DataFrame, shards: int) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), lang.alias("lang"), F.xxhash64(lang).alias("code"), F.coalesce("text", F.lit("")).alias("text"))


def _words(batches):
    """(shard, lang, n): words by shard and language, once a batch."""
    kernel = Phrases(1)
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for top, last, data, offsets in slices(batch.column("text")):
            kernel.of(data, offsets, np.zeros(last - top, np.uint64))
            n[top:last] = np.bincount(kernel.text, minlength=last - top)
        own = pa.table({"shard": batch.column("shard"), "lang": batch.column("lang"), "n": pa.array(n)}).group_by(["shard", "lang"]).aggregate([("n", "sum")])
        yield from own.rename_columns(["shard", "lang", "n"]).to_batches()


def _in_shard(keys: np.ndarray, shard: np.ndarray | int, shards: int) -> np.ndarray:
    """Keys as longs whose remainder is the shard."""
    held = (keys >> np.uint64(2)).astype(np.int64)
    return held - held % shards + shard


def _miner(most: int, shards: int):
    def run(batches):
        kernel, held, n = Phrases(most), [], 0

        def counted():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)]), pa.array(counts[a : a + (1 << 16)])], names=["key", "n"])

        for batch in batches:
            shard, langs = batch.column("shard").to_numpy(), batch.column("code").to_numpy().view(np.uint64)
            for top, last, data, offsets in slices(batch.column("text")):
                kernel.of(data, offsets, langs[top:last])
                for at, keys in zip(kernel.at, kernel.keys, strict=True):
                    held.append(_in_shard(keys, shard[top:last][kernel.text[at]], shards))
                    n += len(keys)
                if n > FLUSH:
                    yield from counted()
                    held, n = [], 0
        if n:
            yield from counted()

    return tidy(run)


def _marker(bits: int):
    def run(batches):
        local = sketch.LocalSketch(bits)
        for batch in batches:
            local.add(batch.column(0).to_numpy().view(np.uint64))
            if local.n > sketch.FLUSH:
                yield from local.rows(twice=True)
        yield from local.rows(twice=True)

    return run


def _counter(most: int, shards: int, bases: list[int], whole=None, bits: int = 0):
    """(key, lang, words, phrase, a): phrases that may be candidates (all, without a sketch), counted by slice of text."""

    def run(batches):
        kernel = Phrases(most, bases)
        for batch in batches:
            names, codes = batch.column("lang"), batch.column("code").to_numpy().view(np.uint64)
            for top, last, data, offsets in slices(batch.column("text"), 1 << 20):
                langs = codes[top:last]
                kernel.of(data, offsets, langs)
                second = kernel.second(langs)
                for k in range(1, most + 1):
                    at, other = kernel.at[k - 1], second[k - 1]
                    keys = _in_shard(kernel.keys[k - 1], 0, shards).view(np.uint64)
                    if whole is not None:
                        may = np.flatnonzero(sketch.repeated(whole.value, bits, keys))
                        at, other, keys = at[may], other[may], keys[may]
                    if not len(at):
                        continue
                    order = np.argsort(keys)
                    same = (keys[order][1:] == keys[order][:-1]) & (other[order][1:] == other[order][:-1])
                    head = np.flatnonzero(np.concatenate([[True], ~same]))
                    counts = np.diff(np.concatenate([head, [len(order)]]))
                    first = at[order[head]]
                    lang = names.take(pa.array(top + kernel.text[first]))
                    columns = [pa.array(keys[order[head]].view(np.int64)), lang, pa.array(np.full(len(first), k, np.int32)), kernel.written(first, k), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "words", "phrase", "a"])

    return tidy(run)


def frequent(docs: DataFrame, support: int = 10, most_words: int = 3, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, a) of all phrases of up to ``most_words`` words with ``support`` occurrences in their
    language, and (lang, n), the words of each language."""
    shards = max(1, support // 2)
    texts = _texts(docs, shards)
    sizes = materialise(texts.select("shard", "lang", "text").mapInArrow(_words, "shard int, lang string, n long").groupBy("shard", "lang").agg(F.sum("n").alias("n")))
    own = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    total = max(1, sum(own.values()))
    lowered = F.element_at(F.array(*[F.lit(-(-support * own.get(s, 0) // total)).cast("long") for s in range(shards)]), F.pmod("key", F.lit(shards)).cast("int") + 1)
    # tasks have counted already: the exchange is by key, without another sum before it
    mined = texts.select("shard", "code", "text").mapInArrow(_miner(most_words, shards), "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    candidates = materialise(mined.where(F.col("n") >= F.greatest(lowered, F.lit(1))).select("key"))
    n, bases = candidates.count(), fresh_bases(2)
    keys = candidates.select((F.col("key") - F.pmod("key", F.lit(shards))).alias("key"))
    again, schema = texts.select("lang", "code", "text"), "key long, lang string, words int, phrase string, a long"
    if n <= most:
        bits = sketch.bits_for(n)
        whole = sketch.merged(keys.mapInArrow(_marker(bits), sketch.SCHEMA), bits)
        found = again.mapInArrow(_counter(most_words, shards, bases, whole, bits), schema)
    else:
        found = again.mapInArrow(_counter(most_words, shards, bases), schema).join(keys.distinct(), "key", "left_semi")
    exact = found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= support)
    return materialise(exact), sizes.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, support: int = 10, most_words: int = 3, covered_percent: int = 50, first: int = 2000) -> DataFrame:
    """The ``first`` best phrases of 2 to ``most_words`` words of each language: lang, rank, phrase, words, cut, a, l, r, n, score.

    A phrase is scored at its worst cut, and left out if a longer candidate that holds it has ``covered_percent`` of its
    occurrences. Ties go to the more frequent, then to the first in byte order."""
    counts, sizes = frequent(docs, support, most_words)
    part = lambda name, size: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(size))
    phrases = counts.where(F.col("words") > 1)
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', cut)"), "tail": F.expr("substring_index(phrase, ' ', cut - words)")})
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    square = (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    score = F.expr("wide div under")
    scored = cuts.withColumns({"wide": square.cast("decimal(38,0)"), "under": (l * r).cast("decimal(38,0)")}).withColumn("score", score.cast("long"))
    worst = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))")
    holds = phrases.where(F.col("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = worst.join(holds, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent))
    # the best of a language are among the best of its parts, so that no task takes all phrases of one
    order, rank = [F.desc("worst.score"), F.desc("a"), F.col("phrase")], F.col("rank") <= first
    parted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(rank)
    best = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(rank)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "worst.cut", "a", "worst.l", "worst.r", "n", "worst.score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

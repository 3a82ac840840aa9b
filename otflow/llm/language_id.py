"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of up to ``LONGEST`` bytes of a
fixed public vocabulary (byte-level, with all single bytes, so that any text can be
cut into pieces). The probability of a word is the sum over all its segmentations
into such pieces, by the forward algorithm; a text's is the product over its words. Piece probabilities are fitted by expectation
maximisation on the words of a bounded sample of labelled documents.

Words are cut at white space, lower-cased and reduced to their letters, without
the space before them; those longer than ``PART`` bytes are scored in parts of
``PART`` bytes, whose segmentations aren't summed across the cut. A task scores
each distinct word once and keeps its scores (forgetting them beyond ``CACHE`` words).

Bounds: at most ``sample`` labelled documents a language are fitted on, in
expectation, of which the ``max_words`` most frequent words; at most
``MAX_LANGUAGES`` languages.

Nulls and oddities: a null text, or one without a letter, is ``und`` with score
0; rows with a null lang are not learned from; null doc_ids count as the empty
text in the fold; with nothing to learn from all is ``und``. Ties go to the
alphabetically first language. Repeated rows are predicted alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST, PART, CACHE, MAX_LANGUAGES = 6, 32, 120_000, 500
UNKNOWN = "und"
_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def load_pieces(path: str, longest: int = LONGEST) -> list[np.ndarray]:
    """For each length the sorted numbers of the vocabulary's pieces: their bytes, big end first."""
    found: list[set] = [set() for _ in range(longest + 1)]
    found[1] = set(range(256))
    with open(path, "rb") as file:
        for line in file:
            piece = base64.b64decode(line.split()[0])
            if len(piece) <= longest:
                found[len(piece)].add(int.from_bytes(piece, "big"))
    return [np.array(sorted(x), np.uint64) for x in found]


def letters(word: bytes) -> bytes:
    text = word.decode("utf-8", "replace").lower()
    return (text if text.isalpha() else _OTHER.sub("", text)).encode()


class Segmenter:
    """Forward and backward sums over all segmentations of words, many words of one length at a time."""

    def __init__(self, pieces: list[np.ndarray]):
        self.pieces = pieces
        self.first = np.cumsum([0, *(len(p) for p in pieces)])
        self.size = int(self.first[-1])

    def numbers(self, words: np.ndarray) -> list[np.ndarray]:
        """[length](word, end) piece number, or ``size`` where the bytes are no piece."""
        n, out, packed = words.shape[1], [np.zeros(0)], words.astype(np.uint64)
        for length in range(1, min(len(self.pieces) - 1, n) + 1):
            if length > 1:
                packed = (packed[:, :-1] << np.uint64(8)) | words[:, length - 1 :]
            known = self.pieces[length]
            if not len(known):
                out.append(np.full(packed.shape, self.size))
                continue
            at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
            out.append(np.where(known[at] == packed, self.first[length] + at, self.size))
        return out

    def forward(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(words, languages) probabilities; ``p`` is (size + 1, languages) with a last row of zeros."""
        numbers, n = self.numbers(words), words.shape[1]
        alpha = np.zeros((n + 1, len(words), p.shape[1]))
        alpha[0] = 1
        for end in range(1, n + 1):
            for length in range(1, min(len(numbers) - 1, end) + 1):
                alpha[end] += alpha[end - length] * p[numbers[length][:, end - length]]
        return alpha[n]

    def expect(self, words: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the counted words, for one language."""
        numbers, n = self.numbers(words), words.shape[1]
        alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        alpha[0] = beta[n] = 1
        for end in range(1, n + 1):
            for length in range(1, min(len(numbers) - 1, end) + 1):
                alpha[end] += alpha[end - length] * p[numbers[length][:, end - length]]
        for start in range(n - 1, -1, -1):
            for length in range(1, min(len(numbers) - 1, n - start) + 1):
                beta[start] += beta[start + length] * p[numbers[length][:, start]]
        out, scale = np.zeros(self.size + 1), counts / alpha[n]
        for length in range(1, len(numbers)):
            for start in range(n - length + 1):
                at = numbers[length][:, start]
                out += np.bincount(at, alpha[start] * p[at] * beta[start + length] * scale, minlength=self.size + 1)
        return out


def by_length(words: list[bytes]):
    """(indices, matrix) of parts of equal length; a long word has several parts."""
    parts = [(len(w[k : k + PART]), i, w[k : k + PART]) for i, w in enumerate(words) for k in range(0, len(w), PART)]
    parts.sort(key=lambda x: x[0])
    lengths = np.array([x[0] for x in parts])
    for n in np.unique(lengths):
        a, b = np.searchsorted(lengths, [n, n + 1])
        for k in range(a, b, 5_000):
            own = parts[k : min(b, k + 5_000)]
            yield np.array([x[1] for x in own]), np.frombuffer(b"".join(x[2] for x in own), np.uint8).reshape(len(own), n)


def fit_pieces(words: list[bytes], counts: np.ndarray, pieces: list[np.ndarray], rounds: int = 4, smoothing: float = 0.02) -> np.ndarray:
    """Probabilities of all pieces (the last entry, for no piece, is 0) from counted words."""
    segmenter = Segmenter(pieces)
    p = np.full(segmenter.size + 1, 1 / segmenter.size)
    p[-1] = 0
    for _ in range(rounds):
        got = np.zeros_like(p)
        for index, matrix in by_length(words):
            got += segmenter.expect(matrix, counts[index].astype(float), p)
        got[-1] = 0
        got[:-1] += smoothing
        p = got / got.sum()
    return p


def held_out_fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def _count_words(batches):
    for batch in batches:
        langs = batch.column(0).to_pylist()
        counts: dict = {}
        for lang, text in zip(langs, batch.column(1), strict=True):
            for w in text.as_py().encode().split() if text.is_valid else ():
                if own := letters(w):
                    counts[lang, own] = counts.get((lang, own), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def fit(train: DataFrame, vocabulary: str = VOCABULARY, sample: int = 1_500, max_words: int = 40_000) -> tuple[list[str], np.ndarray]:
    """Languages and their (pieces + 1, languages) probabilities, from labelled documents (text, lang, doc_id)."""
    labelled = train.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in sizes)
    pieces = load_pieces(vocabulary)
    if not langs:
        return [], np.zeros((sum(map(len, pieces)) + 1, 0))
    spark = train.sparkSession
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in sizes], "lang string, share double"))
    drawn = labelled.join(share, "lang").where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)) < F.col("share")).select("lang", "text")
    counts = drawn.mapInArrow(tidy(_count_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counts.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("turn") <= max_words)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        p = fit_pieces([bytes(w) for w in frame["word"]], frame["n"].to_numpy(), pieces)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "p": [p.tobytes()]})

    fitted = {r["lang"]: np.frombuffer(r["p"]) for r in top.groupBy("lang").applyInPandas(one, "lang string, p binary").collect()}
    langs = [x for x in langs if x in fitted]
    return langs, np.stack([fitted[x] for x in langs], 1) if langs else np.zeros((sum(map(len, pieces)) + 1, 0))


class WordScores(dict):
    """Word -> row of ``table``, the log probabilities in each language. Words not yet known are scored together."""

    def __init__(self, segmenter: Segmenter, p: np.ndarray):
        super().__init__()
        self.segmenter, self.p = segmenter, p
        self.table, self.used = np.zeros((1 << 12, p.shape[1])), 0

    def learn(self, words: set) -> None:
        if len(self) > CACHE:
            self.clear()
            self.used = 0
        words = [w for w in words if w not in self]
        own = [letters(w) for w in words]
        scores = np.zeros((len(words), self.p.shape[1]))
        for index, matrix in by_length(own):
            np.add.at(scores, index, np.log(np.maximum(self.segmenter.forward(matrix, self.p), 1e-300)))
        while self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(words)] = scores
        self.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language under equal priors."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((load_pieces(vocabulary), p))  # pieces x languages, both bounded
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])

    def run(batches):
        pieces, probabilities = model.value
        words = WordScores(Segmenter(pieces), probabilities)
        for batch in batches:
            column, labels, scores = batch.column(text), [], []
            for first, last, data, offsets in slices(column):
                raw = data.tobytes()
                cut = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                words.learn(set().union(*cut))
                for row, own in enumerate(cut):
                    if not langs or not own or not _LETTER.search(raw[offsets[row] : offsets[row + 1]].decode("utf-8", "replace")):
                        labels.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = words.table[[words[w] for w in own]].sum(axis=0)
                    best = int(total.argmax())
                    labels.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, **how) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from the documents that are not held out."""
    fold = held_out_fold(F.col("doc_id"), folds)
    langs, p = fit(docs.where(fold != held_out), **how)
    return predict(docs.drop(*[c for c in docs.columns if c.lower() == "held_out"]).withColumn("held_out", fold == held_out), langs, p)


def digest(docs: DataFrame) -> DataFrame:
    langs, p = fit(docs.where(held_out_fold(F.col("doc_id"), 3) != 1))
    slim = docs.select("doc_id", (held_out_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return predict(slim, langs, p).select("doc_id", "held_out", "lang_pred", "score")

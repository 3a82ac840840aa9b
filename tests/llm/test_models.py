"""LM scoring, language ID and the pipeline: against brute force, probability laws and held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from otflow.llm import language_id, lm_scoring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["th", "er", "ing", "ly", "wh"], "bb": ["eau", "ê", "oi", "que", "ç"], "cc": ["ung", "ß", "sch", "ver", "ö"]}


def texts(seed, n=120):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))]
        out.append((i, " ".join(words), lang, f"s{i % 4}", 1))
    return out


def test_segmentations_are_summed():
    pieces = language_id.load_pieces(language_id.VOCABULARY)
    segmenter = language_id.Segmenter(pieces)
    p = np.random.default_rng(1).random((segmenter.size + 1, 2))
    p[-1] = 0
    number = {}
    for length, own in enumerate(pieces):
        number |= {int(x).to_bytes(length, "big"): int(segmenter.first[length]) + i for i, x in enumerate(own)}
    word = b"theeau"
    want = np.zeros(2)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if all(x in number for x in parts):
            want += np.prod([p[number[x]] for x in parts], axis=0)
    matrix = np.frombuffer(word, np.uint8)[None, :]
    assert np.allclose(segmenter.forward(matrix, p)[0], want)
    # expected uses of pieces weigh to the word's length
    own = p[:, 0]
    got = segmenter.expect(matrix, np.array([1.0]), own)
    sizes = np.concatenate([np.full(len(x), k) for k, x in enumerate(pieces)])
    assert math.isclose((got[:-1] * sizes).sum(), len(word))


def test_language_id(spark):
    rows = texts(3) + [(500, None, "aa", "s", 1), (501, "123 $%&", None, "s", 1), (502, "", "bb", "s", 1), (None, "ung ver schung", None, None, None), (503, "eau " * 3000, "bb", "s", 1), (503, "eau", "bb", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    out = language_id.identify(df).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.text and any(c.isalpha() for c in r.text)]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    for r in out:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not r.text or "$" in r.text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in out if r.doc_id is None} == {"cc"}
    assert language_id.digest(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.digest(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lm_scoring(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 20)
    rows = [(i, t if i % 5 else t.upper(), lang, s, n) for i, t, lang, s, n in texts(5, 90)] + [(None, "the end", None, None, None), (200, None, None, None, None), (200, "", None, None, None), (201, "new" * 400, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = lm_scoring.digest(df).collect()
    assert len(got) == len(rows)
    lower = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t, *_ in rows if not held(i)]
    counts = Counter(w for t in train for w in lower(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = Counter()
    for i, t, *_ in rows:
        own = [*[counts.get(w, 0) for w in lower(t)], len(train)]
        want[(i, held(i), len(own), sum(c > 0 for c in own), n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in own), 6))] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.digest(df.limit(0)).collect() == []


def test_context_helps_on_held_out_texts(spark):
    """Texts of three closed vocabularies: their own words before tell which; the base can't."""
    rng, rows = random.Random(8), []
    vocabulary = {lang: ["".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(150)] for lang, own in SYLLABLES.items()}
    for i in range(300):
        rows.append((i, " ".join(rng.choice(list(vocabulary.values())[i % 3]) for _ in range(40))))
    got = [r for r in lm_scoring.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect() if r.held_out]
    assert len(got) > 20 and all(r.score > r.base_score for r in got)
    # a third of all words each: context is worth up to log10(3) a word
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.6 * math.log10(3)


def test_experts_sum_to_one(spark):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in texts(5, 90)]
    train = spark.createDataFrame(rows, DOCS).select("text").repartition(3)
    ranks = spark.sparkContext.broadcast(lm_scoring.read_ranks(lm_scoring.VOCABULARY))
    _, model, _ = lm_scoring.fit(train, ranks)
    assert np.allclose(np.exp(model["logs"]).sum(axis=0) + np.exp(model["rest"]), 1, atol=1e-4)
    assert np.allclose(model["steps"]["one"].sum(axis=1), 1, atol=1e-4)
    s, before, row = model["steps"], 65, 7
    assert np.allclose((s["two"][row][:, None] + s["more"][row] * s["one"][before]).sum(axis=0) / s["sum"][row], 1, atol=1e-4)
    # a word outside the head: the product of its steps
    own = lm_scoring.WordModels(model, ranks.value)
    own.stream(np.frombuffer(b"xyzzy", np.uint8), np.array([0, 5]))
    ids = own.codec.encode_ordinary(" xyzzy")
    word, before, to, row = lm_scoring._steps(np.array(ids), np.array([len(ids)]))
    assert len(to) == len(ids) + 1 and to[-1] == before[0] == lm_scoring.IDS
    want = [model["rest"][k] + sum(math.log((s["two"][r, t] + s["more"][r] * s["one"][b, t, k]) / s["sum"][r]) for b, t, r in zip(before, to, row, strict=True)) for k in range(lm_scoring.EXPERTS)]
    assert np.allclose(own.logs[own.numbers[b"xyzzy"]], want, atol=1e-3)


def layer(seed):
    rng = np.random.default_rng(seed)
    w = lm_scoring.initial_weights()
    return rng, {k: rng.standard_normal(x.shape) * (0.3 if k != "out" else 1) for k, x in w.items()}


def stream_of(rng, sizes):
    """Random tokens before each token of texts of some sizes (filled up as the operator does), starts, and which are real."""
    hold, block = lm_scoring.HOLD, lm_scoring.BLOCK
    filled = [-(-n // hold) * hold for n in sizes]
    n = -(-sum(filled) // block) * block
    start, real, at = np.full(n, sum(filled)), np.zeros(n, bool), 0
    for size, whole in zip(sizes, filled, strict=True):
        start[at : at + whole] = at
        real[at : at + size] = True
        at += whole
    return rng.integers(0, 50, n), start, real


def test_gradient_is_the_slope():
    rng, w = layer(0)
    flat = rng.integers(0, 30, 75)
    first = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 75), 49, replace=False))])  # 50 words of some ids each
    stream, start, real = stream_of(rng, [25, 3, 30])
    x, seen = lm_scoring.windows(stream, start)
    logs = rng.standard_normal((len(stream), lm_scoring.EXPERTS)) * 2

    def loss():
        logits, _ = lm_scoring.attend(w, lm_scoring.embedded(w, flat, first), x, seen)
        return -lm_scoring.mixed(logits, logs)[0][real].mean()

    g = lm_scoring.gradient(w, lm_scoring.embedded(w, flat, first), flat, first, x, seen, logs, real)
    at, other = int(flat[first[stream[20]]]), int(flat[first[stream[5]]])
    for name, place in (("ids", (at, 3)), ("ids", (at, 5)), ("ids", (at, 9)), ("ids", (other, 12)), ("ids", (other, 1)), ("out", (2, 5)), ("bias", (4,)), ("near", (1,))):
        kept = w[name][place]
        w[name][place] = kept + 1e-4
        up = loss()
        w[name][place] = kept - 1e-4
        assert abs((up - loss()) / 2e-4 - g[name][place]) < 1e-4, name
        w[name][place] = kept


def test_windows_score_each_token_once_and_causally():
    rng, w = layer(2)
    flat, first = np.arange(50), np.arange(50)
    stream, start, _ = stream_of(rng, [33, 37, 8])
    hold = lm_scoring.HOLD
    run = lambda s: lm_scoring.attend(w, lm_scoring.embedded(w, flat, first), *lm_scoring.windows(s, start))[0]
    a = run(stream)
    assert len(a) * hold == len(stream)
    for changed in range(len(stream)):
        other = stream.copy()
        other[changed] = 49 - other[changed]
        moved = ~np.isclose(a, run(other)).all(axis=1)
        mine = start[::hold] == start[changed]
        # nothing before the change, nothing in other texts, nothing beyond the reach
        assert not moved[~mine].any() and not moved[np.arange(len(a)) * hold < changed].any()
        assert not moved[np.arange(len(a)) * hold >= changed + lm_scoring.REACH + lm_scoring.BLOCK].any()
        if changed % hold == 0:
            assert moved[changed // hold]


def test_every_token_asks_attention_itself():
    rng, w = layer(3)
    flat, first = np.arange(50), np.arange(50)
    stream, start, real = stream_of(rng, [33, 37, 8])
    run = lambda s: lm_scoring.attend(w, lm_scoring.embedded(w, flat, first), *lm_scoring.windows(s, start))[0]
    a = run(stream)
    assert len(a) == len(stream)
    for changed in np.flatnonzero(real):
        other = stream.copy()
        other[changed] = 49 - other[changed]
        # the word right before a token moves that token's gates
        assert not np.isclose(a[changed], run(other)[changed]).all()


def test_pipeline(spark, tmp_path):
    base = texts(9, 60)
    item = "the quick question about seven rivers and their long bridges near old towns and harbours in spring"
    rows = base + [(100, base[0][1], "aa", "s0", 1), (101, base[0][1] + " ly", "aa", "s0", 1), (102, "123 456", None, "s1", 1), (103, None, "aa", "s1", 1), (104, f"thing whly {item} wher thly", "aa", "s2", 1), (7, base[7][1], base[7][2], base[7][3], 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = Counter(r.doc_id for r in docs.collect())
    assert set(seen["language_id"]) == {r[0] for r in rows} - {102, 103} and seen["language_id"][7] == 2
    near = seen["near_dedup"]
    assert near[7] == 1 and 100 not in near and near[0] == 1 and set(near.values()) == {1}
    assert set(near) - set(seen["decontamination"]) == {104}
    assert set(seen["mixing"]) == set(seen["decontamination"]) and set(seen["mixing"].values()) <= {1, 2}
    assert seen["sharding"] == seen["mixing"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in run.collect()) == seen["sharding"]
    empty = docs.sparkSession.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

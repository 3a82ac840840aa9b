"""Packing: ids, round trip, best fit and padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from otflow.llm import packing as P

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string"


def plain_best_fit(sizes, window):
    """Looks at every open window."""
    room, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [k for k in range(len(room)) if room[k] >= sizes[i]]
        least = min((room[k] for k in fits), default=None)
        k = next((k for k in fits if room[k] == least), None)
        if k is None:
            room.append(window)
            out.append([])
            k = len(room) - 1
        room[k] -= sizes[i]
        out[k].append(i)
    return out, room


@pytest.mark.parametrize("window", [1, 2, 7, 64, 1000])
def test_best_fit_takes_the_tightest_window(window):
    draw = random.Random(window)
    for _ in range(20):
        sizes = np.array([draw.randint(1, window) for _ in range(draw.randrange(60))], np.int64)
        got, (want, room) = P.best_fit(sizes, window), plain_best_fit(sizes.tolist(), window)
        assert sorted(i for w in got for i in w) == list(range(len(sizes)))
        assert sorted(window - sum(int(sizes[i]) for i in w) for w in got) == sorted(room) and len(got) == len(want)
        cut = P.filled_up(sizes, window)
        assert all(sum(z - a for _, a, z in w) == window for w in cut[:-1])
        assert Counter((i, k) for w in cut for i, a, z in w for k in range(a, z)) == Counter((i, k) for i, n in enumerate(sizes.tolist()) for k in range(n))


def made():
    draw = random.Random(5)
    words = ["the", "Über", "naïve", "12,345", "don't", "一二三", "🙂", "x" * 50, " ", P.SPECIAL]
    gaps = [" ", "  ", "\n", "\n\n ", "\t", ""]
    rows = [(draw.choice([i, i, None, 7]), "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(400)))) for i in range(60)]
    rows += [(100 + i, "same text of some length " * 120) for i in range(40)]  # each a little over half a window
    return [*rows, (1, None), (2, ""), (3, " "), (4, "very long text, of words " * 9000), (4, "y" * 20000)]


def check(rows, out, window=P.WINDOW):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*tokens.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    windows, docs = defaultdict(list), defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= window
    possible = defaultdict(list)
    for (d, _), x in zip(rows, ids, strict=True):
        possible[(d, len(x))].append(np.array(x, "<u4"))
    assert docs.keys() == possible.keys()
    for key, own in docs.items():
        assert Counter(k for s, n, _ in own for k in range(s, s + n)) == Counter({k: len(possible[key]) for k in range(key[1])})
        assert all(any(zlib.crc32(x[s : s + n].tobytes()) == c for x in possible[key]) for s, n, c in own)
    return [window - sum(n for _, n in own) for own in windows.values()]


@pytest.mark.parametrize(("window", "group"), [(1024, 1 << 15), (1024, 10), (100, 64)])
def test_every_id_once_and_little_padding(spark, window, group):
    rows = made()
    out = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), VOCABULARY, PATTERN, window, 8, group)
    padding = check(rows, out.collect(), window)
    assert sum(p > 8 for p in padding) <= 2 + len(rows) // group + 1


def test_parts_have_the_tokens_of_the_whole():
    text = "".join(random.Random(1).choice(["a", " ", "b ", "\n", "1", "!", "é", "  ", " \n"]) for _ in range(5000))
    ids = P.tokenizer(VOCABULARY, PATTERN)
    apart = [x for p in P.parts(text, 50) for x in ids(p)[:-1].tolist()]
    assert "".join(P.parts(text, 50)) == text and apart == ids(text)[:-1].tolist() and sum(1 for _ in P.parts(text, 50)) > 20


def test_empty_table_and_other_columns(spark):
    assert P.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, None, 1, "a")], SCHEMA + ", length int, ids string")
    assert [tuple(r)[:5] for r in P.digest(docs).collect()] == [(None, 0, 1, zlib.crc32(bytes(4)), 1)]

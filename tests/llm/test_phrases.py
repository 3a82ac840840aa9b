"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import pytest

from otflow.llm import phrase_mining as M


def brute(rows, support=10, most=3, percent=50, first=2000):
    counts, words = {}, Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            own.update(" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        held = {p: a for p, a in own.items() if a >= support and " " in p}
        scored = []
        for p, a in held.items():
            w = p.split(" ")
            score, k, l, r = min((1_000_000 * a * a // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k, own[" ".join(w[:k])], own[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(f" {p} " in f" {q} " and 100 * b >= percent * a for q, b in held.items() if len(q.split(" ")) > len(w)):
                scored.append((-score, -a, p.encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, words[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def made(n, seed=3):
    draw = random.Random(seed)
    words = ["Ab", "ab", "cd", "É", "ß", "x1", "naïve", "zz-top", "q", "一", "long" * 40]
    gaps = [" ", "  ", "\t", ", ", ".\n", "\x0b", "\xa0"]
    out = [(draw.choice([None, i, i, i]), draw.choice([None, "en", "de", ""]), "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(30)))) for i in range(n)]
    out += [(7, "en", "one two three four. one two three") for _ in range(n // 3)] + [(1, "en", None), (2, None, ""), (3, "fr", " ,. \t\n")]
    return out + [(9, "en", "very long text of words, " * 3000)]


SCHEMA = "doc_id long, lang string, text string"


@pytest.mark.parametrize(("support", "most", "most_candidates"), [(10, 3, None), (4, 4, None), (10, 3, 0), (1, 2, None)])
def test_against_brute_force(spark, monkeypatch, support, most, most_candidates):
    monkeypatch.setattr(M, "FLUSH", 500)
    if most_candidates is not None:  # hashes are joined instead of sketched
        real = M.frequent
        monkeypatch.setattr(M, "frequent", lambda d, s, w: real(d, s, w, most_candidates))
    rows = made(90)
    got = M.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), support, most, 50, 60).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, support, most, 50, 60)


def test_empty_and_clashing_columns(spark):
    assert M.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert M.digest(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []
    rows = [(i, "en", "a b") for i in range(12)]
    docs = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA + ", key string, n int, shard string")
    assert [tuple(r) for r in M.digest(docs).collect()] == brute(rows)


def test_counts_beyond_64_bits(spark, monkeypatch):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big * 2), ("en", 1, "b", big * 3), ("en", 2, "a b", big)], "lang string, words int, phrase string, a long")
    monkeypatch.setattr(M, "frequent", lambda *_: (counts, spark.createDataFrame([("en", big * 5)], "lang string, n long")))
    assert M.collocations(None).first()["score"] == 1_000_000 // 6

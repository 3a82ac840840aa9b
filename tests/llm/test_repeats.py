"""Substring and suffix dedup against brute force."""

import hashlib
import random

import pytest

from otflow.llm import substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed, n=40, words=60):
    rng = random.Random(seed)
    vocabulary = ["der", "the", "é", "x", "zwölf", "on", "ab", "123", "日本"] + [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(words))]
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(5) : rng.randrange(20, 30)]
        if i % 7 == 0:
            own += ["again"] * rng.randrange(40)
        out.append(rng.choice([" ", "\n", "  ", "\t"]).join(own))
    out += [out[3], out[3], None, "", "   ", out[9] + " tail"]
    return out


def rows(seed):
    own = [(i, t, "en", "s", 1) for i, t in enumerate(texts(seed))]
    own += [(None, texts(seed)[6], None, None, None), (5, "other " + (texts(seed)[3] or ""), None, None, None), own[12], own[12]]
    random.Random(seed).shuffle(own)
    return own


def brute_words(data, window):
    from pyspark.sql import functions as F  # noqa: F401

    first, out = {}, []
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        own = (r[1] or "").encode().split()
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            first.setdefault(key, (r[0], r[1], s))
    for r in order:
        own = (r[1] or "").encode().split()
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] != (r[0], r[1], s):
                gone |= set(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((r[0], len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    data = [r for r in rows(seed) if r[0] != 5 or not (r[1] or "").startswith("other ")]
    df = spark.createDataFrame(data, DOCS).repartition(5)
    got = substring_dedup.dedup_substrings(df, window=8, reach=6, gram=4)
    assert {"lang", "source", "n_chars", "spans"} <= set(got.columns)
    from pyspark.sql import functions as F

    found = [tuple(x) for x in got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(found, key=key) == sorted(brute_words(data, 8), key=key)


def brute_bytes(data, length):
    seen, out = {}, []
    raw = [(r[1] or "").encode() for r in data]
    for t in raw:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            seen[k] = seen.get(k, 0) + 1
    for r, t in zip(data, raw, strict=True):
        gone = set()
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone |= set(range(s, s + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(b for i, b in enumerate(t) if i not in gone)
        out.append((r[0], len(t), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 6])
def test_bytes_against_brute_force(spark, seed, parts):
    data = rows(seed)
    df = spark.createDataFrame(data, DOCS).repartition(parts)
    got = suffix_dedup.dedup_suffixes(df, length=40, reach=14, gram=6)
    from pyspark.sql import functions as F

    found = [tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(found, key=key) == sorted(brute_bytes(data, 40), key=key)


def test_bytes_at_full_length(spark):
    """400 bytes: passages of just that length, one less and more, at texts' ends, overlapping themselves, and a very long text."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij ä") for _ in range(n))
    passage = "".join(rng.choice("klmnop") for _ in range(900))
    own = [text(rng.randrange(200, 1500)) for _ in range(20)]
    own += [passage[:400] + text(50), text(30) + passage[:400], text(300) + passage[100:499] + text(10), passage[500:], passage[499:], passage]
    own += ["xyz" * 300, "q" * 401, "q" * 400, "r" * 400, text(200_000) + passage[450:] + text(10)]
    data = [(i, t, "en", "s", 1) for i, t in enumerate(own)]
    got = suffix_dedup.digest(spark.createDataFrame(data, DOCS).repartition(3))
    assert sorted(tuple(r)[:5] for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == sorted(brute_bytes(data, 400))


def test_radix_groups():
    import numpy as np

    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([9, 16, 20]))) for _ in range(400)] + [b"c" * 20] * 3
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(x) for x in strings])
    at, group = suffix_dedup.radix_groups(data, np.cumsum(size) - size, size, np.zeros(len(size), np.uint64))
    found = {}
    for i, g in zip(at.tolist(), group.tolist(), strict=True):
        found.setdefault(g, set()).add(i)
    want = {}
    for i, x in enumerate(strings):
        want.setdefault(x, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    # groups that end together come in the order of their bytes
    names = [strings[min(v)] for _, v in sorted(found.items()) if len(strings[min(v)]) == 20]
    assert names == sorted(names)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_strings_that_collide_modulo_a_power_of_two(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {other}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.digest(df).collect()} == {0}
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.dedup_suffixes(df, length=2048, reach=96, gram=24).collect()} == {0}


def test_fingerprints_are_polynomials():
    import numpy as np

    from otflow.llm.common import Fingerprint, times

    p, rng = (1 << 61) - 1, np.random.default_rng(3)
    a, b = rng.integers(0, p, 40_000, dtype=np.uint64), rng.integers(0, p, 40_000, dtype=np.uint64)
    a[:3], b[:3] = [p - 1, 0, p - 1], [p - 1, p - 1, 1]
    assert times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    f = Fingerprint(123456789012345678)
    prefix = f.prefix(a[:1000])
    got = f.of(prefix, np.array([3, 0, 999]), np.array([10, 1000, 999]))
    want = [sum(v * pow(f.base, i, p) for i, v in enumerate(a[s:e].tolist())) % p for s, e in ((3, 10), (0, 1000), (999, 999))]
    assert got.tolist() == want


@pytest.mark.parametrize("name", ["mark", "doc", "_doc", "_mark", "spans", "_found_doc", "lo", "kept", "n_removed"])
def test_clashing_columns(spark, name):
    rows = [(1, "a b c d e f g h i j", "x"), (2, "a b c d e f g h i j", "y"), (3, None, None)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
    for out, n in ((substring_dedup.dedup_substrings(df, window=5, reach=4, gram=3), [0, 10, 0]), (suffix_dedup.dedup_suffixes(df, length=10, reach=6, gram=3), [19, 19, 0])):
        got = sorted(out.collect(), key=lambda r: r["doc_id"])
        assert [r["n_removed"] for r in got] == n
        if name not in ("spans", "kept", "n_removed"):
            assert [r[name] for r in got] == ["x", "y", None]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert substring_dedup.digest(df).collect() == []
    assert suffix_dedup.digest(df).collect() == []

"""Near-dedup against brute force over all pairs."""

import random

import pytest

from otflow.llm import minhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def make(seed, groups=12):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "ß", "Über"]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 120))]
        for _ in range(rng.randrange(1, 9) if g else 60):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own) if rng.random() < 0.7 else "\n ".join(own).upper())
    out += ["", None, " \t", "one", "ONE", "two words", out[0], out[0], out[5]]
    rng.shuffle(out)
    return list(enumerate(out))


def brute(data):
    sets = {i: shingles(t) for i, t in data}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 9)])
def test_against_brute_force(spark, seed, block):
    data = make(seed)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], DOCS).repartition(5)
    got = minhash_dedup.link_documents(df, block=block).drop("node")
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (None, long + " x"), (4, long), (4, long), (9, "another text of five words"), (9, "unlike the one before it"), (None, "alone here"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.digest(df).collect())
    assert got == sorted([("None", 47, 4, False), ("None", 48, 4, False), ("4", 47, 4, True), ("4", 47, 4, True), ("9", 2, 9, True), ("9", 2, 9, True), ("None", 1, None, True), ("7", 0, 7, True)])
    assert minhash_dedup.digest(df.limit(0)).collect() == []


def test_long_words_that_collide_modulo_a_power_of_two(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    df = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.digest(df).collect()} == {(1, 1), (2, 2)}


def test_large_ids_and_clashing_columns(spark):
    long, top = " ".join(f"w{i}" for i in range(50)), (1 << 62) + 5
    rows = [(top, long, "a"), (top + 1, long, "b"), (-7, "alone in the world here", "c"), (None, long, "d"), (None, "other words than all the rest", "e")]
    for name in ("_id", "_turn", "node", "n", "component", "sig"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {name} string")
        got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.digest(df).collect()}
        assert got == {(top, top, True), (top + 1, top, False), (-7, -7, True), (None, top, False), (None, None, True)}
        if name in ("_id", "_turn"):
            kept = minhash_dedup.keep_one(df, shingle=5, percent=80)
            assert sorted(r[name] for r in kept.collect()) == ["a", "c", "d", "e"] and kept.columns == df.columns

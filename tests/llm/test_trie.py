"""Prefix trie and tree contraction against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from otflow.llm import prefix_trie as T
from otflow.llm.tree_contraction import subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, group=100, most=6):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [x[3:] for x in sorted(own)] for c, own in convs.items()}
    members = defaultdict(list)
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = abs(c) // group * group * (1 if c >= 0 else -1)
        full[c] = (*convs.get(base, [])[:h], *own[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def plain(out):
    return sorted(tuple(r) for r in out.collect())


def made(seed=2):
    draw = random.Random(seed)
    say = ["hi", "Ünï", "", None, "🙂 ok", "what?", "long " * 30]
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(say)) for c in [*range(60), *range(100, 130), *range(-30, -20), 5000, 5003] for t in range(draw.randrange(1, 9))]
    rows += [(7, None, "user", "hi"), (7, None, "user", "hi"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 1, "user", "hi"), (8, 2, None, None)]
    rows += [(c, t, "user", f"t{t}") for c in range(300, 340) for t in range(4)]  # copies
    return rows + [(410, t, "user", f"deep {t // 2}") for t in range(150)] + [(411, t, "user", f"deep {t // 2}") for t in range(120)]


@pytest.mark.parametrize(("block", "rows"), [(1 << 16, 1 << 20), (16, 20)])
def test_against_brute_force(spark, monkeypatch, block, rows):
    monkeypatch.setattr(T, "IDS", 8)
    made_rows = made()
    got = T.trie(spark.createDataFrame(made_rows, SCHEMA).repartition(3), block=block, rows=rows)
    assert plain(got) == brute(made_rows)


def test_repeated_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    rows = [(4, 1, "user", "same")] * 50 + [(4, 2, "user", "end"), (5, 1, None, "x")]
    assert plain(T.trie(spark.createDataFrame(rows, SCHEMA), block=8)) == brute(rows)


def test_empty_and_clashing(spark):
    assert T.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    rows = [(c, t, "user", "a") for c in (1, 2, 104) for t in range(3)]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA + ", depth int, size int, id string")
    assert plain(T.trie(docs)) == brute(rows)


@pytest.mark.parametrize("shape", ["random", "path", "star", "comb", "forest", "one"])
def test_contraction_of_any_shape(spark, shape):
    draw, n = random.Random(shape), 1 if shape == "one" else 300
    parents = {"random": lambda i: draw.randrange(i), "path": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: draw.choice([None, i - 1, draw.randrange(i)])}
    parent = [None] + [parents[shape](i) for i in range(1, n)]
    value = [[draw.randrange(-5, 99), 1] for _ in range(n)]
    total = [list(v) for v in value]
    for i in reversed(range(n)):
        if parent[i] is not None:
            total[parent[i]] = [a + b for a, b in zip(total[parent[i]], total[i], strict=True)]
    nodes = spark.createDataFrame([(f"n{i}", None if p is None else f"n{p}", v) for i, (p, v) in enumerate(zip(parent, value, strict=True))], "id string, parent string, value array<long>")
    assert dict(subtree_totals(nodes).select("id", "total").collect()) == {f"n{i}": t for i, t in enumerate(total)}


def test_no_nodes(spark):
    assert subtree_totals(spark.createDataFrame([], "id long, parent long, value array<long>")).select(F.count("id")).first()[0] == 0

"""Exact top-k against brute force; decontamination on planted and re-parameterised questions; URL filters, sharding, mixing."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from otflow.llm import decontamination, mixing, sharding, topk_search, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk(spark, scale):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.standard_normal(6) * scale]) for i in range(400)]
    data += [(400, data[7][1]), (401, data[7][1]), (500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (600, [1.0, 2.0]), (700, [2.0, 1.0]), (None, data[3][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(3)
    rows = topk_search.whole_vectors(df)
    got = [tuple(r) for r in topk_search.search(rows, rows.where("vec_id % 100 = 0"), 10, shard_rows=90).collect()]
    fit = {i: [math.floor(1024 * x) for x in v] for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in fit.items():
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fit.items() if i != q and len(w) == len(v))[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_topk_odd_rows(spark):
    """Repeated query rows are one query; ids with several vectors; values that no double product holds; ties; clashing names."""
    data = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.5])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(data, schema)
    for name in ("v", "dim", "shard", "floor", "score", "tree"):
        got = [(r.query_id, r["rank"], r.vec_id) for r in topk_search.digest(df.withColumn(name, F.lit("x"))).collect()]
        assert sorted(got) == [(100, 1, 1), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    huge = spark.createDataFrame([(100, [1e306, 1.0]), (1, [1e300, -1e300]), (2, [1e9, 3.0]), (200, [1e12, 1.0]), (3, [1e12, 0.0])], schema)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.digest(huge).collect()}
    top = (1 << 63) - 1
    assert got == {(200, 1): (1, top), (200, 2): (2, top), (200, 3): (3, top)}
    exact = spark.createDataFrame([(0, [float(2**20), 3.0]), (1, [float(2**20), 1.0 + 2**-10]), (2, [float(2**20), 1.0])], schema)
    got = [(r.vec_id, r.score) for r in topk_search.digest(exact).orderBy("rank").collect()]
    assert got == [(1, 2**60 + 3 * 1024 * 1025), (2, 2**60 + 3 * 1024 * 1024)]


ITEMS = [
    (1, "A train leaves the station with Alice at 40 km per hour and then meets Bob after 3 hours. How far did it go?"),
    (2, "Which of the following rivers crosses the old border before it turns to the north sea near the lighthouse?"),
    (3, "too short"),
]


def test_templates(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [
        (1, f"{noise(30)}. {ITEMS[0][1]} {noise(20)}"),
        (2, f"{noise(10)}. A train leaves the station with Carol at 55 km per hour and then meets Dave after 7 hours. How far did it go? {noise(5)}"),
        (3, f"{noise(50)} WHICH of the following rivers crosses,\nthe old border before it turns to the north sea near the lighthouse"),
        (4, noise(200)),
        (5, "A train was late. Which of the following rivers is long?"),
        (6, None),
        (7, ""),
        (None, ITEMS[1][1]),
        (1, "clean text under an id used twice, with nothing of note in it"),
    ]
    docs += [docs[0]]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).withColumn("hash", F.lit(9)).withColumn("shape", F.lit("x"))
    bench = spark.createDataFrame([*ITEMS, (4, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.contaminated, tuple(r.item_ids)) for r in decontamination.judge(df, bench).collect())
    assert got == sorted([("1", True, (1,)), ("1", True, (1,)), ("1", False, ()), ("2", True, (1,)), ("3", True, (2,)), ("4", False, ()), ("5", False, ()), ("6", False, ()), ("7", False, ()), ("None", True, (2,))])
    kept = decontamination.remove_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == 5
    assert decontamination.judge(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.judge(df.limit(0), bench).collect() == []


def test_case_names_and_numbers(spark):
    item = "Yesterday Alice Smith sold 12 apples to Bob in the old market and then gave Carla Maria Jones 3 more of them before lunch."
    copies = {
        1: item, 2: item.lower(), 3: item.upper(), 4: item.replace(" ", "\n  "),
        5: item.replace("Alice Smith", "Dora").replace("Carla Maria Jones", "Erik Meyer"), 6: item.replace("12", "twelve").replace("3", "five"),
        7: "Yesterday nobody sold a thing at the market, and lunch was late for all of them.",
    }
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontamination.judge(df, bench).collect()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_stretches_of_long_texts(spark):
    """A passage across the cut of a very long text, and one at its end; ties and clashing names."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(6000)]
    item = "the quick question about seven rivers and their long bridges near old towns and harbours in spring"
    at = decontamination.STRETCH - 7
    docs = [(1, " ".join(words[:at] + item.split() + words[at:])), (2, " ".join(words + item.split())), (2, " ".join(words + item.split())), (3, " ".join(words))]
    bench = spark.createDataFrame([(5, item), (6, item)], "item_id long, text string")
    for name in ("window", "key", "tokens", "form", "mark", "row_mark", "_key", "found"):
        df = spark.createDataFrame([(*d, "x") for d in docs], f"doc_id long, text string, {name} string")
        got = sorted((r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontamination.judge(df, bench).collect())
        assert got == [(1, True, (5, 6)), (2, True, (5, 6)), (2, True, (5, 6)), (3, False, ())]
    found = {(r.doc_id, r.item_id): r.found - r.n_windows for r in decontamination.find(df, bench).collect()}
    assert set(found.values()) == {0}


def test_slots_must_correspond(spark):
    item = "If x equals 5 and later 5 is added to the old sum of all of the given coins we have enough"
    same = item.replace("5", "8")
    other = item.replace("5", "8", 1).replace("5", "9", 1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, same), (2, other)], "doc_id long, text string")
    found = {r.doc_id: r.found for r in decontamination.find(df, bench, coverage=0.0).collect()}
    assert found[1] == 18 and found[2] < found[1]


def test_names_in_copies(spark):
    item = "On Monday Maria bought 3 apples in Paris and gave Tom 2 of them before she met Anna in Rome."
    start = "Alice has 3 apples. Alice buys 4 pears. How many fruits has Alice?"
    bench = spark.createDataFrame([(1, item), (2, start), (3, "Rivers of Old Spain")], "item_id long, text string")
    docs = [
        (1, item), (2, item.lower()), (3, item.replace(" ", "\n")), (4, item.replace(" ", "  ")), (5, item.lower().replace("3", "7")), (6, item.replace(" ", "\u00a0").replace("Maria", "Carla").replace("Tom", "Jim").replace("2", "5")),
        (7, start.replace("Alice", "Carol").replace("3", "8")), (8, "we saw the rivers of old spain today"), (9, "rivers of old"), (10, "He likes apples. On Sunday they bought a car and gave it to a friend in town. How many were there?"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontamination.judge(df, bench).collect()}
    assert got == {1: [1], 2: [1], 3: [1], 4: [1], 5: [1], 6: [1], 7: [2], 8: [3], 9: [], 10: []}
    found = {r.doc_id: (r.found, r.n_windows) for r in decontamination.find(df, bench).where("item_id = 1").collect()}
    assert all(found[i][0] == found[i][1] for i in (1, 2, 3, 4, 6))


def test_rules_and_graph(spark):
    pages = [
        (1, "HTTP://Www.EXAMPLE.com/en/7?x#y", None), (2, "http://a.com/en/1", '<a href="http://b.fr/x">'), (3, "http://c.de", "<a href='//b.fr/'>"),
        (4, "no scheme", None), (5, None, None), (6, "http://b.fr/fr/", '<a href="/rel">'), (7, "x://m.example.net/de/8", None), (8, "x://example.net/de/9", '<a href="http://good.fr">'), (9, "x://good.fr#z", None),
        (10, "http://q.fr/", '<a href="http://a.com/">'), (11, "x://notexample.com/en/7", None), (11, "x://notexample.com/en/7", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df, ["example.com/en/7", "net/de/"], ["com/en/", "example.net/de/8", "org/es/"]).collect()}
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.com", "/en/1", "com/en/", "block") and got[4] == ("", "", None, "allow") == got[5]
    assert got[7] == ("m.example.net", "/de/8", "example.net/de/8", "block") and got[8][2:] == ("net/de/", "allow")
    assert got[9] == ("good.fr", "", None, "allow") and got[10][3] == "block" and got[11][2:] == ("com/en/", "block")
    assert url_filters.filter_urls(df.limit(0), [], []).collect() == []


def test_propagation(spark):
    edges = [("a", "x", "y", 1.0), ("a", "y", "z", 1.0), ("a", "y", "x", 3.0)]
    seeds = [("a", "x", 2.0)]
    got = {r.host: r.mass for r in url_filters.propagate(spark.createDataFrame(edges, "kind string, src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, host string, mass double"), iterations=30).collect()}
    m = {"x": 0.3, "y": 0.0, "z": 0.0}
    for _ in range(30):
        m = {"x": 0.3 + 0.85 * m["y"] * 0.75, "y": 0.85 * m["x"], "z": 0.85 * m["y"] * 0.25}
    assert all(abs(got[h] - m[h]) < 1e-9 for h in m)


def test_sharding(spark):
    data = [(i if i % 50 else None, None if i % 97 == 0 else f"tä {i % 7}", "en", "s", 1) for i in range(1003)]
    df = spark.createDataFrame(data, DOCS).withColumn("shard", F.lit("old")).repartition(7)
    rows = sharding.shard_rows(df, shards=13, block_rows=20).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 1003 and set(sizes.values()) == {77, 78} and set(sizes) == set(range(13))
    for s in range(13):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((d[0] or -1, d[1] or "") for d in data)
    assert sharding.shard_digest(df.limit(0)).collect() == []
    matrix = sharding.communication_matrix({0: 5, 1: 0, 2: 8}, 4, 1)
    assert [int(matrix[p].sum()) for p in (0, 1, 2)] == [5, 0, 8] and sorted(sum(matrix.values()).tolist()) == [3, 3, 3, 4]


def test_shard_digest_of_odd_rows(spark):
    """Sizes and checksums are those of the UTF-8 bytes; nulls, repeated rows, a very long text and clashing names keep the law."""
    import zlib

    data = [(i, t) for i, t in enumerate(["", "é", "日本", "x" * 300_000, None, "same", "same"])] + [(None, "same"), (None, None)] + [(100 + i, f"t{i}") for i in range(80)]
    for name in ("shard", "slot", "_at", "size"):
        df = spark.createDataFrame([(*r, "x") for r in data], f"doc_id long, text string, {name} string").repartition(3)
        df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}")
        rows = sharding.shard_digest(spark.read.parquet(path)).collect()
        raw = lambda t: (t or "").encode()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in data)
        assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
        own = {}
        for r in rows:
            own.setdefault(r.shard, []).append(r.slot)
        assert set(own) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in own.values())
        assert {len(x) for x in own.values()} == {2, 3}


def test_matrix_is_hypergeometric():
    draws = [sharding.communication_matrix({0: 6, 1: 6}, 3, seed)[0] for seed in range(3000)]
    mean = np.mean(draws, axis=0)
    assert np.allclose(mean, 2, atol=0.08)
    assert abs(np.var([d[0] for d in draws]) - 6 * (1 / 3) * (2 / 3) * (6 / 11)) < 0.06


def test_large_draws_follow_the_law():
    """Against numpy where both can: the same law, by its quantiles; and sizes beyond numpy's range."""
    rng = np.random.default_rng(9)
    for good, bad, n in ((500, 700, 300), (5, 10_000, 4_000), (30_000, 20, 29_990)):
        us = (np.arange(4_000) + 0.5) / 4_000
        ours = np.array([sharding.large_draw(u, good, bad, n) for u in us])
        theirs = rng.hypergeometric(good, bad, n, 40_000)
        assert ours.min() >= max(0, n - bad) and ours.max() <= min(n, good)
        assert abs(ours.mean() - theirs.mean()) < 0.05 * theirs.std() + 1e-9 and abs(ours.std() - theirs.std()) < 0.05 * theirs.std() + 1e-9
    big = [sharding.large_draw(u, 3 * 10**10, 10**11, 2 * 10**9) for u in (0.001, 0.5, 0.999)]
    middle = 2 * 10**9 * 3 / 13
    assert big[0] < big[1] < big[2] and abs(big[1] - middle) < 100 and big[2] - big[0] < 200_000


def mixing_rows():
    rng = random.Random(4)
    out = [(i, " ".join("w" for _ in range(rng.randrange(1, 30))), "en", "big" if i % 3 else f"s{i % 5}", 1) for i in range(900)]
    return out + [(None, None, None, None, None), (1000, "", "en", "big", 0), (1001, "a b", "en", None, 3)]


def brute_mix(data, budget, **target):
    tokens = Counter()
    for _, t, _, s, _ in data:
        tokens[s] += len((t or "").split())
    alpha = mixing.bisect_exponent(dict(tokens), budget=budget, **target)
    weights = mixing.shares(dict(tokens), alpha)
    return tokens, weights, mixing.passes(dict(tokens), weights, budget)


@pytest.mark.parametrize(("budget", "target"), [(None, {"repetition_limit": 2.0}), (5000.0, {"target_entropy": 1.2}), (20000.0, {"repetition_limit": 2.5})])
def test_mixing(spark, budget, target):
    data = mixing_rows()
    df = spark.createDataFrame(data, DOCS).withColumn("weight", F.lit(3)).repartition(4)
    got = mixing.mix(df, budget=budget, bucket_rows=40, **target).collect()
    tokens, weights, passes = brute_mix(data, budget, **target)
    taken = Counter()
    for r in got:
        taken[r.source] += r.n_tokens * r.copies
    longest = 30
    for s, n in tokens.items():
        want = passes[s] * n
        assert want - longest <= taken[s] <= want + 1e-6
        copies = [r.copies for r in got if r.source == s] or [0]
        assert max(copies) - min(copies) <= 1
    if budget is None:
        assert len(got) == len(data) and abs(max(passes.values()) / min(passes.values()) - 2.0) < 1e-6
    if "target_entropy" in target:
        assert abs(mixing.entropy(weights) - 1.2) < 1e-6
    assert mixing.mix(df.limit(0), repetition_limit=2.0).collect() == []
    # the sequence itself: gapless permutations of each source's documents, cut by the budget in the last block
    rows = mixing.block_permutations(df, budget=budget, bucket_rows=40, **target).collect()
    assert Counter((r.source, r.doc_id) for r in rows) == Counter({(r.source, r.doc_id): 0 for r in got} | Counter({k: sum(r.copies for r in got if (r.source, r.doc_id) == k) for k in {(r.source, r.doc_id) for r in got}}))
    blocks = {}
    for r in rows:
        blocks.setdefault((r.source, r.block), []).append(r)
    n_docs = Counter(s for _, _, _, s, _ in data)
    orders = {}
    for (source, block), own in blocks.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        whole = math.floor(passes.get(source, 1.0) + 1e-9)
        assert len(own) == n_docs[source] if block < whole else sum(r.n_tokens for r in own) <= (passes[source] - whole) * tokens[source] + 1e-6
        orders[source, block] = [r.doc_id for r in own]
    for (source, block), order in orders.items():
        if block == 0 and len(order) > 20:
            assert order != sorted(order) and order != orders.get((source, 1), [])[: len(order)]


def test_mixing_of_odd_tables(spark):
    """Repeated rows, no tokens, null sources and ids, a very long text, clashing names."""
    data = [(1, "a b", None), (1, "a b", None), (None, None, "x"), (2, "", "x"), (3, "w " * 50_000, "y"), (4, "w " * 50_000, "y")]
    for name in ("_number", "weight", "block", "position", "draw", "n_tokens", "_of"):
        df = spark.createDataFrame([(*r, "kept") for r in data], f"doc_id long, text string, source string, {name} string")
        rows = mixing.block_permutations(df, repetition_limit=2.0).collect()
        assert Counter(r.source for r in rows if r.block == 0) == {None: 2, "x": 2, "y": 2}
        got = mixing.mix(df, repetition_limit=2.0)
        assert sum(r.copies for r in got.collect()) == len(rows)
        if name in ("block", "position", "draw"):
            assert {r[name] for r in got.collect()} == {"kept"}
    empty = spark.createDataFrame([(1, None, "x"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.block, r.position) for r in mixing.block_permutations(empty, repetition_limit=2.0).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert mixing.block_permutations(empty.limit(0), repetition_limit=2.0).collect() == []


def brute_verdicts(pages, allow, block, iterations=10):
    """Hosts, rules and verdicts in plain Python."""
    import re

    rules = [(*url_filters.split_rule(r), r, v) for v, rs in (("allow", allow), ("block", block)) for r in rs]
    out, hosts, links = {}, {}, Counter()
    for key, url, html in pages:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for h, p, r, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out[key] = (host, path, *(max(fit)[1:] if fit else (None, None)))
        hosts.setdefault(host, Counter())[out[key][3]] += 1
        for target in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", html or ""):
            to = re.match(r"[^/?#]*", target.partition("//")[2])[0].lower()
            if host and to and to != host:
                links[host, to] += 1
    steps = set()
    for h in hosts:
        labels = h.split(".")
        steps |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])) for i in range(len(labels) - 2)} if h else set()
    for a, b in steps:
        links[a, b] += 1
        links[b, a] += 1
    mass = {}
    for kind in ("allow", "block"):
        total = sum(c[kind] for c in hosts.values())
        seeds = {h: c[kind] / total for h, c in hosts.items() if c[kind]}
        edges = links if kind == "allow" else {(b, a): n for (a, b), n in links.items()}
        degree = Counter()
        for (a, _), n in edges.items():
            degree[a] += n
        now = {h: 0.15 * m for h, m in seeds.items()}
        for _ in range(iterations):
            new = Counter({h: 0.15 * m for h, m in seeds.items()})
            for (a, b), n in edges.items():
                new[b] += 0.85 * now.get(a, 0.0) * n / degree[a]
            now = new
        mass[kind] = now
    for key, (host, path, rule, verdict) in out.items():
        trust, distrust = mass["allow"].get(host, 0.0), mass["block"].get(host, 0.0)
        out[key] = (host, path, rule, verdict or ("block" if distrust > 0.5 * (trust + distrust) else "allow"))
    return out


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    names = ["a.example.com", "b.example.com", "www.a.example.com", "bad.example.org", "m.bad.example.org", "good.net", "x.good.net", "solo.fr", "Deep.x.good.net"]
    paths = ["/en/7", "/en/8?x", "/de/8", "/de/9", "/es/1", "/es/", "", "#z", "/fr/"]
    pages = [(i, f"http://{rng.choice(names)}{rng.choice(paths)}", " ".join(f'<a href="http://{rng.choice(names)}/q">' for _ in range(rng.randrange(3)))) for i in range(150)]
    pages += [(200, None, None), (201, "nothing", '<a href="//good.net">'), (202, "x://very.long.fr/" + "p" * 100_000, "y " * 100_000)]
    allow, block = ["example.com/en/7", "net/de/"], ["com/en/", "example.net/de/8", "org/es/"]
    want = brute_verdicts(pages, allow, block)
    assert len({v[3] for k, v in want.items() if v[2] is None}) == 2
    for name in ("_host", "trust", "_of", "best", "mass", "rule"):
        df = spark.createDataFrame([(*p, "x") for p in pages], f"page_id long, url string, html string, {name} string").repartition(3)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df, allow, block).collect()}
        assert got == want

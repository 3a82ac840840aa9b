"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct ``shingle``-word shingles (lower-cased);
documents are linked where 100 * intersection >= 80 * union.

1. A shingle is a fingerprint modulo 2**61 - 1 of its words' fingerprints, with
   bases drawn for each query. Sets get a fingerprint and a signature of 64
   minhashes of 16 bits. Equal sets are one class from here on.
2. Signatures are split into 16 chunks of 4. Two signatures that differ in at
   most 31 places have, by the pigeonhole principle, a chunk with at most one
   difference; every chunk is a key in 4 ways, one place left out each time.
   So every pair within distance 31 shares a key. Sets at the least linked
   similarity differ in 12.8 places on average; more than 31 has probability
   below 2e-7.
3. Keys that occur once are dropped by a count-min sketch. Under each remaining
   key, signatures within the distance are joined into groups; the groups'
   connected components are the clusters.
4. In each cluster pairs within the distance are confirmed on the full sets,
   except those already connected by confirmed links, and the connected
   components of confirmed links are the result.

Keys and clusters of any size are cut into blocks of ``block`` members, and pairs
of blocks are the units of work: a task holds two blocks, results are spanning
forests (fewer links than members), and no pair within the distance is skipped.

Nulls and oddities: a null or empty text has an empty set and is linked with
nothing; fewer words than a shingle are one whole shingle; repeated rows are
linked; rows that share a doc_id are one document with several texts, linked by
the doc_id. A row without doc_id takes part, but never names a component; a
component of only such rows has a null id and is kept. An empty table gives an
empty result. Columns named like the operator's own are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sketch
from .common import BASES, Fingerprint, ascii_lower, fresh_bases, materialise, mix, slices, tidy, word_bounds
from .graph import components

PLACES, CHUNKS = 64, 16
REACH = 2 * CHUNKS - 1
#: Node numbers of rows without doc_id start here, or behind the largest doc_id.
NAMELESS = 1 << 62
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)
SIGNED = "doc_id long, node long, n_shingles long, f1 long, f2 long, sig binary"


class Shingles:
    """Shingles of ``size`` words; ``bases``: of the fingerprints of bytes and of words."""

    def __init__(self, size: int, bases: list[int]):
        self.size = size
        self.bytes_, self.words = (Fingerprint(b) for b in bases)

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """(text index, hash) of the distinct shingles of each text, in text order."""
        data = ascii_lower(data)
        starts, ends, first = word_bounds(data, offsets)
        words = self.bytes_.of(self.bytes_.prefix(data), starts, ends)
        prefix = self.words.prefix(words)
        counts = np.diff(first)
        sizes = np.where(counts >= self.size, counts - self.size + 1, np.minimum(counts, 1))
        text = np.repeat(np.arange(len(counts)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        hashes = self.words.of(prefix, at, at + np.minimum(counts, self.size)[text])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        if len(text):
            fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])
            text, hashes = text[fresh], hashes[fresh]
        return text, hashes


def signatures(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """(sets, PLACES) minhashes of 16 bits; ``heads`` are the first elements of the sets."""
    out = np.empty((len(heads), PLACES), np.uint16)
    for i in range(PLACES):
        out[:, i] = mix(np.minimum.reduceat(hashes * _A[i] + _B[i], heads)) & np.uint64(0xFFFF)
    return out


def nameless_node(f1: np.ndarray, first: int) -> np.ndarray:
    """A node from ``first`` on for a row without doc_id, from its set."""
    return (np.uint64(first) + f1.view(np.uint64) % np.uint64((1 << 63) - first)).view(np.int64)


def _signer(size: int, bases: list[int], nameless_from: int):
    def run(batches):
        kernel = Shingles(size, bases)
        for batch in batches:
            ids = batch.column(0)
            nameless = np.array(ids.is_null())
            known = ids.fill_null(0).to_numpy()
            for top, end, data, offsets in slices(batch.column(1)):
                text, hashes = kernel.of(data, offsets)
                n = end - top
                heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
                sizes, has = np.bincount(text, minlength=n), np.unique(text)
                f1, f2, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, PLACES), np.uint16)
                if len(heads):
                    f1[has] = np.add.reduceat(mix(hashes ^ np.uint64(BASES[0])), heads).view(np.int64)
                    f2[has] = np.add.reduceat(mix(hashes ^ np.uint64(BASES[1])), heads).view(np.int64)
                    sig[has] = signatures(hashes, heads)
                node = np.where(nameless[top:end], nameless_node(f1, nameless_from), known[top:end])
                raw = sig.astype("<u2").tobytes()
                width = 2 * PLACES
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(top, n), pa.array(node), pa.array(sizes.astype(np.int64)), pa.array(f1), pa.array(f2), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])],
                    names=["doc_id", "node", "n_shingles", "f1", "f2", "sig"],
                )

    return tidy(run)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PLACES)


def _keys(sig: np.ndarray) -> np.ndarray:
    """(signatures, 64) keys: each chunk with each of its places left out."""
    width = PLACES // CHUNKS
    chunks = sig.reshape(-1, CHUNKS, width).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, width), np.uint64)
    for left_out in range(width):
        x = np.full(chunks.shape[:2], 0, np.uint64)
        for place in range(width):
            if place != left_out:
                x = (x << np.uint64(16)) | chunks[:, :, place]
        out[:, :, left_out] = mix(x ^ mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(width) + np.uint64(left_out + 1))[None, :])
    return out.reshape(len(sig), PLACES)


def _key_sketcher(bits: int):
    def run(batches):
        local = sketch.LocalSketch(bits)
        for batch in batches:
            local.add(_keys(_sigs(batch.column(0))).ravel())
            if local.n > sketch.FLUSH:
                yield from local.rows()
        yield from local.rows()

    return tidy(run)


def _key_rows(whole, bits: int, which: slice):
    def run(batches):
        for batch in batches:
            node, label, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            keys = np.ascontiguousarray(_keys(_sigs(sig))[:, which])
            row, col = np.nonzero(sketch.repeated(whole.value, bits, keys.ravel()).reshape(keys.shape))
            for a in range(0, len(row), 100_000):
                part = row[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part, col[a : a + 100_000]].view(np.int64)), pa.array(node[part]), pa.array(label[part]), sig.take(pa.array(part))], names=["key", "node", "label", "sig"])

    return tidy(run)


#: Groups above a block's size are broadcast up to this many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_GROUPS = 1_000_000


def in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows once for each pair of blocks of their group that they belong to: adds ``lo``, ``hi``, ``block``.

    Blocks hold about ``block`` rows; a group below that is the one pair (0, 0)."""
    large = materialise(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    held = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    placed = rows.join(held, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return placed.withColumn("_other", other).withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_blocks", "_other")


def _units(batches, columns: list[str]):
    """Pieces of a partition sorted by (group, lo, hi), one unit each; a batch boundary may fall inside a unit."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch]).select(columns)
        held = pa.concat_tables([held, now]) if held is not None else now
        if held.num_rows == 0:
            continue
        key = [held.column(i).to_numpy() for i in range(3)]
        head = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])]))
        if len(head) > 1:
            yield held.slice(0, head[-1]).combine_chunks(), head[:-1], int(head[-1])
        held = held.slice(head[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0]), held.num_rows


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint8)
    for i in range(PLACES):
        out += a[:, i, None] != b[None, :, i]
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of the connected parts of edges a - b, without the smallest members themselves."""
    node, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(node))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label[x], new[x])
        np.minimum.at(new, label[y], new[y])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


SMALL, PAIRS = 32, 1 << 16
#: Keys of a signature, those of its first chunk, that are compared ahead of the others.
FIRST_KEYS = PLACES // CHUNKS


def _small_pairs(heads: np.ndarray, sizes: np.ndarray):
    """Index pairs of all groups of one size at a time, in pieces."""
    for size in np.unique(sizes):
        x, y = np.triu_indices(size, 1)
        own = heads[sizes == size]
        step = max(1, PAIRS // len(x))
        for k in range(0, len(own), step):
            at = own[k : k + step, None]
            yield (at + x).ravel(), (at + y).ravel()


def _near_groups(batches):
    """Edges (a, b) between labels that join, under each key, all signatures within the distance; one forest for all that a
    task sees, without those whose label is the same already."""
    held_a, held_b = [], []
    for table, heads, n in _units(batches, ["key", "lo", "hi", "block", "label", "sig"]):
        label, block = table.column("label").to_numpy(), table.column("block").to_numpy()
        sig = _sigs(table.column("sig"))
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        sizes = np.diff(np.concatenate([heads, [n]]))
        plain = (sizes > 1) & (sizes <= SMALL) & (lo[heads] == hi[heads])
        for x, y in _small_pairs(heads[plain], sizes[plain]):
            near = ((sig[x] != sig[y]).sum(axis=1) <= REACH) & (label[x] != label[y])
            held_a.append(label[x[near]])
            held_b.append(label[y[near]])
        for at, size in zip(heads[(sizes > 1) & ~plain], sizes[(sizes > 1) & ~plain], strict=True):
            own = slice(at, at + size)
            close = _distance(sig[own], sig[own]) <= REACH
            if lo[at] != hi[at]:
                close &= block[own][:, None] != block[own][None, :]
            close &= label[own][:, None] != label[own][None, :]
            x, y = np.nonzero(np.triu(close, 1))
            x, y = _forest(label[at + x], label[at + y])
            held_a.append(x)
            held_b.append(y)
        if len(held_a) > 64:
            x, y = _forest(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b = [x], [y]
    if held_a:
        x, y = _forest(np.concatenate(held_a), np.concatenate(held_b))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _confirm(size: int, percent: int, bases: list[int]):
    """Confirmed links of each unit of a cluster, as a spanning forest."""

    def run(batches):
        kernel = Shingles(size, bases)
        for table, heads, n in _units(batches, ["cluster", "lo", "hi", "block", "node", "sig", "text"]):
            ends = np.concatenate([heads[1:], [n]])
            for a, b in zip(heads, ends, strict=True):
                unit = table.slice(a, b - a)
                found = _unit_links(kernel, unit, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return tidy(run)


def _unit_links(kernel: Shingles, unit: pa.Table, percent: int) -> list[tuple[int, int]]:
    node, block = unit.column("node").to_numpy(), unit.column("block").to_numpy()
    sig = _sigs(unit.column("sig"))
    sets: list = [frozenset()] * len(node)
    for top, end, data, offsets in slices(unit.column("text")):
        text, hashes = kernel.of(data, offsets)
        cuts = np.searchsorted(text, np.arange(end - top + 1))
        for i in range(end - top):
            sets[top + i] = hashes[cuts[i] : cuts[i + 1]]
    sizes = np.array([len(s) for s in sets])
    distance = _distance(sig, sig)
    near = (distance <= REACH) & (100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes))
    if unit.column("lo")[0].as_py() != unit.column("hi")[0].as_py():
        near &= block[:, None] != block[None, :]
    x, y = np.nonzero(np.triu(near, 1))
    order = np.argsort(distance[x, y], kind="stable")
    parent, links, made = list(range(len(node))), [], {}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        p, q = root(i), root(j)
        if p == q:
            continue
        for k in (i, j):
            if k not in made:
                made[k] = set(sets[k].tolist())
        both = len(made[i] & made[j])
        if 100 * both >= percent * (len(made[i]) + len(made[j]) - both):
            parent[p] = q
            links.append((int(node[i]), int(node[j])))
    return links


def link_documents(docs: DataFrame, shingle: int = 4, percent: int = 80, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the node number of every row of ``docs``."""
    if percent < 80:
        raise ValueError("the signature distance is set for similarities of 0.8 or more")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bases, top = fresh_bases(2), slim.agg(F.max("doc_id")).first()[0]
    nameless_from = max(NAMELESS, (top or 0) + 1)
    if nameless_from > (1 << 63) - (1 << 40):
        # too few numbers are left for rows without doc_id
        if not slim.where("doc_id is null").limit(1).isEmpty():
            raise ValueError("doc_id reaches the end of its range, and there are rows without one")
        nameless_from = (1 << 63) - 1
    signed = materialise(slim.mapInArrow(_signer(shingle, bases, nameless_from), SIGNED))
    filled = signed.where("n_shingles > 0")
    classes = materialise(filled.groupBy("f1", "f2").agg(F.min("node").alias("node"), F.first("sig").alias("sig")))
    same = filled.join(classes.select("f1", "f2", F.col("node").alias("rep")), ["f1", "f2"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    bits = sketch.bits_for(PLACES * classes.count())
    whole = sketch.merged(classes.select("sig").mapInArrow(_key_sketcher(bits), sketch.SCHEMA), bits)

    def near(labelled: DataFrame, which: slice) -> DataFrame:
        keys = labelled.select("node", "label", "sig").mapInArrow(_key_rows(whole, bits, which), "key long, node long, label long, sig binary")
        units = in_blocks(keys, "key", block).select("key", "lo", "hi", "block", "label", "sig")
        return units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(tidy(_near_groups), "a long, b long")

    # large groups are joined by their first keys; the other keys then give only what joins two labels
    first = materialise(components(near(classes.withColumn("label", F.col("node")), slice(0, FIRST_KEYS))))
    labelled = classes.join(first, "node", "left").withColumn("label", F.coalesce("component", "node"))
    clusters = materialise(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near(labelled, slice(FIRST_KEYS, None)))))
    members = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    members = members.join(classes.select("node", "sig", "f1", "f2"), "node").select(F.col("component").alias("cluster"), "node", "sig", "f1", "f2")
    # one row speaks for each class: the one with the class's node; its text is looked up by doc_id and set
    texts = _texts_of(docs, members, shingle, bases, nameless_from)
    links = in_blocks(texts, "cluster", block).select("cluster", "lo", "hi", "block", "node", "sig", "text").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(_confirm(shingle, percent, bases), "a long, b long")
    linked = components(links.unionByName(same))
    out = signed.join(linked, "node", "left").withColumn("least", F.coalesce("component", "node"))
    named = F.col("least") <= F.lit(top if top is not None else -(1 << 63))
    own = F.when(named, F.col("least"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"), "node")


def _wanted(bits: int):
    def run(batches):
        local = sketch.LocalSketch(bits)
        for batch in batches:
            local.add(mix(batch.column(0).to_numpy().view(np.uint64)))
            if local.n > sketch.FLUSH:
                yield from local.rows(twice=True)
        yield from local.rows(twice=True)

    return tidy(run)


def _texts_of(docs: DataFrame, members: DataFrame, shingle: int, bases: list[int], nameless_from: int) -> DataFrame:
    """Members with the text of one row each. A sketch of the members' nodes keeps other texts out of the exchange."""
    members = materialise(members)
    bits = sketch.bits_for(members.count())
    whole = sketch.merged(members.select("node").mapInArrow(_wanted(bits), sketch.SCHEMA), bits)

    def wanted(batches):
        kernel = Shingles(shingle, bases)
        for batch in batches:
            ids = batch.column(0)
            named = np.array(ids.is_valid())
            maybe = sketch.repeated(whole.value, bits, mix(ids.fill_null(0).to_numpy().view(np.uint64))) | ~named
            batch = batch.filter(pa.array(maybe))
            if not batch.num_rows:
                continue
            ids, f1 = batch.column(0), []
            for _, _, data, offsets in slices(batch.column(1)):
                text, hashes = kernel.of(data, offsets)
                sums = np.zeros(len(offsets) - 1, np.uint64)
                if len(text):
                    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                    sums[np.unique(text)] = np.add.reduceat(mix(hashes ^ np.uint64(BASES[0])), heads)
                f1.append(sums.view(np.int64))
            f1 = np.concatenate(f1)
            node = np.where(np.array(ids.is_null()), nameless_node(f1, nameless_from), ids.fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(f1), batch.column(1)], names=["node", "f1", "text"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(wanted), "node long, f1 long, text string")
    return found.join(members, ["node", "f1"]).dropDuplicates(["node", "f1", "f2"]).select("cluster", "node", "sig", "text")


def digest(docs: DataFrame) -> DataFrame:
    return link_documents(docs.select("doc_id", "text")).drop("node")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without all but one document of each component. Of rows that share a doc_id the one whose text has the
    smallest hash stays; rows without doc_id can't be named by a result and stay."""
    linked = link_documents(docs.select("doc_id", "text"), **how).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(linked, "doc_id", "left_semi").select(*docs.columns)
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    name = "_turn"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return named.withColumn(name, turn).where(F.col(name) == 1).drop(name).unionByName(docs.where("doc_id is null"))

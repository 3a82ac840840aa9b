"""Packing of tokenised documents into windows by best-fit decreasing.

A document is its ids, then id 0. What fills whole windows is cut off first; the
rest, shorter than a window, is packed by best-fit decreasing: pieces are taken
from the longest down, and each goes to the open window with the least room that
still holds it. A segment tree over the remaining capacities 0 to ``window`` counts
the open windows and finds that one in log2(window) steps, however many are open.

Each task packs the documents it tokenises, ``GROUP`` rests at a time, so ids
don't move. Windows that end with more than ``slack`` tokens to spare are dissolved:
only their pieces are exchanged, with their ids, evenly over groups, and packed
again. What then is still too empty, as when all pieces have a little over half a
window, is filled up by cutting: window by window, the longest piece first, then
heads of the next ones. So all windows but one of each group of the second pass
have at most ``slack`` tokens of padding, whatever the lengths are.

Results: one row a piece. ``start`` counts ids of its document before it,
``offset`` those of its window; ``sequence_id`` is unique, not gapless.
``doc_id`` may be null or repeated: each row is a document of its own. A null or
empty text has only the id 0. Long texts are tokenised in parts that are cut before
a single space between two other characters, where the vocabulary's pattern always
ends a token. ``<|endoftext|>`` in a text becomes the vocabulary's id of it. No rows give no
pieces. Other columns are ignored. Tokens come from the rank file of the same
vocabulary (``tiktoken``), which gives the ids of the ``tokenizers`` file faster; a
vocabulary has 65,536 ids at most.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

WINDOW, SLACK, END, SPECIAL, SPECIAL_ID = 1024, 8, 0, "<|endoftext|>", 50256
#: Rests that a task packs at a time; their ids are held, up to 2 * WINDOW bytes each.
GROUP = 1 << 15
#: Characters of a text that are tokenised at a time, from the first safe cut on.
PART = 1 << 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LOOSE = PIECE + ", ids binary"


class Capacities:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts, self.open = [0] * (2 * self.leaves), [[] for _ in range(window + 1)]

    def put(self, room: int, number: int) -> None:
        self.open[room].append(number)
        at = room + self.leaves
        while at:
            self.counts[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``size``, and that room."""
        counts, at = self.counts, size + self.leaves
        if not counts[at]:
            while at > 1 and not (at & 1 == 0 and counts[at + 1]):  # up, until something open lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            counts[at] -= 1
            at >>= 1
        return self.open[room].pop(), room


def best_fit(sizes: np.ndarray, window: int) -> list[list[int]]:
    """Windows of pieces by best-fit decreasing; ties in size go by position."""
    tree, out = Capacities(window), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        number, room = tree.take(size) or (len(out), window)
        if number == len(out):
            out.append([])
        out[number].append(i)
        if room > size:
            tree.put(room - size, number)
    return out


def filled_up(sizes: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, first id, end) that are all full but the last, from the longest piece down."""
    out, room = [], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        at, size = 0, int(sizes[i])
        while at < size:
            if not room:
                out.append([])
                room = window
            end = min(size, at + room)
            out[-1].append((i, at, end))
            room -= end - at
            at = end
    return out


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts that have the tokens of the whole."""
    first = 0
    while len(text) - first > size:
        at = text.find(" ", first + size)
        while at > 0 and at + 1 < len(text) and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        yield text[first:at]
        first = at
    yield text[first:]


def tokenizer(path: str, pattern: str):
    """Ids of a text, as a numpy array with the end id."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        out: list[int] = []
        for k, plain in enumerate(text.split(SPECIAL)):
            if k:
                out.append(SPECIAL_ID)
            for part in parts(plain):
                out += encoding.encode_ordinary(part)
        out.append(END)
        return np.array(out, np.uint16)

    return ids


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Rows:
    """Columns of pieces on their way out."""

    def __init__(self, task: int):
        self.held, self.loose, self.number = [], [], task << 40

    def window(self, pieces: list[tuple], settled: bool = True) -> None:
        """``pieces``: (doc_id, start, doc_tokens, ids). Loose ones get a number each instead of a window's."""
        offset = 0
        for doc, start, whole, ids in pieces:
            self.held.append((doc, start, len(ids), _crc(ids), whole, self.number, offset))
            self.loose.append(None if settled else ids.tobytes())
            offset += len(ids) if settled else 0
            self.number += not settled
        self.number += settled

    def batches(self, least: int = 0):
        if len(self.held) > least:
            for a in range(0, len(self.held), 1 << 13):
                own = list(zip(*self.held[a : a + (1 << 13)], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in own), pa.array(self.loose[a : a + (1 << 13)], pa.binary())], names=[c.split()[0] for c in LOOSE.split(", ")])
            self.held, self.loose = [], []


def _pack(rests: list[tuple], rows: _Rows, window: int, slack: int, final: bool) -> None:
    """Windows of (doc_id, start, doc_tokens, ids). What is too empty stays loose, or is filled up in the end."""
    over = []
    for own in best_fit(np.array([len(r[3]) for r in rests], np.int64), window):
        held = [rests[i] for i in own]
        if window - sum(len(r[3]) for r in held) <= slack:
            rows.window(held)
        else:
            over += held
    if not final:
        rows.window(over, settled=False)
        return
    for cut in filled_up(np.array([len(r[3]) for r in over], np.int64), window):
        rows.window([(over[i][0], over[i][1] + a, over[i][2], over[i][3][a:z]) for i, a, z in cut])


def _first(path: str, pattern: str, window: int, slack: int, group: int):
    def run(batches):
        ids_of, rows, rests = tokenizer(path, pattern), _Rows(TaskContext.get().partitionId()), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "")
                n = len(ids)
                for start in range(0, n - window + 1, window):
                    rows.window([(doc, start, n, ids[start : start + window])])
                if n % window:
                    rests.append((doc, n - n % window, n, ids[n - n % window :].copy()))
                if len(rests) >= group:
                    _pack(rests, rows, window, slack, False)
                    rests = []
                yield from rows.batches(1 << 13)
        if rests:
            _pack(rests, rows, window, slack, False)
        yield from rows.batches()

    return tidy(run)


def _again(tasks: int, window: int, slack: int, group: int):
    def run(batches):
        rows, rests = _Rows(tasks + TaskContext.get().partitionId()), []
        for batch in batches:
            docs, starts, wholes = (batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
            rests += [(d, s, w, np.frombuffer(x.as_py(), np.uint16)) for d, s, w, x in zip(docs, starts, wholes, batch.column("ids"), strict=True)]
            if len(rests) >= group:
                _pack(rests, rows, window, slack, True)
                rests = []
            yield from rows.batches(1 << 13)
        if rests:
            _pack(rests, rows, window, slack, True)
        yield from rows.batches()

    return tidy(run)


def pack(docs: DataFrame, vocabulary: str, pattern: str, window: int = WINDOW, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of the rank file on the executors and ``pattern`` its pattern of words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = materialise(texts.mapInArrow(_first(vocabulary, pattern, window, slack, group), LOOSE))
    loose = once.where(F.col("ids").isNotNull())
    settled = once.where(F.col("ids").isNull()).drop("ids")
    seen = once.agg(F.count("ids").alias("loose"), F.max(F.shiftright("sequence_id", 40)).alias("last")).first()
    if not seen["loose"]:
        return settled
    tasks, groups = seen["last"] + 1, -(-seen["loose"] // group)
    dealt = loose.repartition(groups, F.col("sequence_id"))  # a number of its own for each piece: even
    return settled.unionByName(dealt.mapInArrow(_again(tasks, window, slack, group), LOOSE).drop("ids"))


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

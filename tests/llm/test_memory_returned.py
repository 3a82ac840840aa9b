"""Python workers are used again by later stages: a task gives its freed memory back at its end."""

import gc

import pyarrow as pa

from otflow.llm import common, language_id, minhash_dedup


def test_near_dedup_tasks_return_memory(monkeypatch):
    calls = []
    monkeypatch.setattr(gc, "collect", lambda *a: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", None])], names=["doc_id", "text"])
    signed = list(minhash_dedup._signer(5, common.fresh_bases(2), minhash_dedup.NAMELESS)([batch]))
    assert sum(b.num_rows for b in signed) == 2 and len(calls) == 1
    members = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["node"])
    list(minhash_dedup._wanted(16)([members]))
    assert len(calls) == 2


def test_words_are_scored_in_steps_of_bounded_size():
    words = [b"%05d" % k for k in range(12_000)]
    parts = list(language_id.by_length(words))
    assert max(len(index) for index, _ in parts) <= 5_000
    assert sorted(i for index, _ in parts for i in index) == list(range(12_000))

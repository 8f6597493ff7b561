"""Packing's workers tokenize a bounded amount of text at a time, whatever the batch; what they return stays the same."""

from unittest import mock

import pyarrow as pa
import pytest

from quillspark.llm import packing


def pieces(batch):
    with mock.patch("pyspark.TaskContext.get") as get:
        get.return_value.partitionId.return_value = 3
        return [r for out in packing._pieces(packing.vocabulary(), 64, 0, True)(iter([batch])) for r in out.to_pylist()]


@pytest.fixture
def batch():
    texts = [" ".join(f"w{(k * n) % 509}" for n in range(k % 97)) for k in range(400)] + [None, "", "long " * 3000]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def test_bounded_portions(batch):
    whole, most = pieces(batch), 4000
    seen, encode = [], packing.WordTokens.encode

    def spy(self, texts):
        seen.append((len(texts), sum(len(t or "") for t in texts.to_pylist())))
        return encode(self, texts)

    with mock.patch.object(packing, "PORTION", most), mock.patch.object(packing.WordTokens, "encode", spy):
        assert pieces(batch) == whole
    assert all(size <= most or rows == 1 for rows, size in seen)
    assert sum(rows for rows, _ in seen) == len(batch) and len(seen) > 10


def test_few_joined_texts_at_once(batch):
    words = [f"word{k}" for k in range(2000)]
    with mock.patch.object(packing, "AT_ONCE", 10**9):
        ids, size = packing.word_ids(packing.vocabulary(), words)
    with mock.patch.object(packing, "AT_ONCE", 3):
        assert [x.tolist() for x in packing.word_ids(packing.vocabulary(), words)] == [ids.tolist(), size.tolist()]

"""A worker's tasks share what its encoder has met."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from slotweave.llm import tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_a_second_task_encodes_new_words_only(monkeypatch):
    asked = []

    def looked_up(self, parts, plain=tokens.PieceEncoder._looked_up):
        asked.append(sum(p not in self.known for p in parts))
        return plain(self, parts)

    monkeypatch.setattr(tokens.PieceEncoder, "_looked_up", looked_up)
    tasks = [["first zqaa words.", None, "x1 [SEP] y"], ["words. first zqbb", "", "zqaa"], ["Zqbb ZQAA first, words"]]
    for texts in tasks:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
        ((_, ids, bounds),) = tokens.encoded_blocks(iter([batch]), VOCABULARY)
        alone, ends = tokens.PieceEncoder(VOCABULARY).encode(batch.column(1))
        assert np.array_equal(ids, alone) and np.array_equal(bounds, ends)
    assert asked[::2][1:] == [1, 1] and asked[1] > 1

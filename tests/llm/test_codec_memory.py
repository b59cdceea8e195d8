"""What a worker holds of the texts it has encoded."""

import pyarrow as pa

from chatloom.llm import base, sentencepiece_codec
from chatloom.llm.queries import PIECES


class Rows:
    """One task over one batch, in this process."""

    def mapInArrow(self, run, schema):
        return list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "text": ["le chat", "", "un chien", "x", "le chat"]})])))


def test_memos_are_given_back_at_the_end_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "whole_texts", lambda docs: docs)
    monkeypatch.setattr(sentencepiece_codec, "CALL_ROWS", 2)
    kept = pa.Table.from_batches(sentencepiece_codec.round_trip(Rows(), PIECES))
    codec = base.per_process(("codec", PIECES), lambda: None)
    assert len(codec.segments) and len(codec.parts)
    batches = sentencepiece_codec.round_trip(Rows(), PIECES, keep_memos=False)
    assert [b.num_rows for b in batches] == [2, 2, 1] and pa.Table.from_batches(batches).to_pylist() == kept.to_pylist()
    assert not codec.segments and not codec.parts and not codec.segments.old and not codec.parts.old

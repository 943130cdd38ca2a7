"""What Python workers keep between operators."""

from __future__ import annotations

import pyarrow as pa

from airside.llm import neardup, packing, tokens


def test_workers_keep_little():
    """A worker's later tasks, of other operators, find no words of this one's; packing has a cache of its own size."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], names=["doc_id", "text"])
    for made in (neardup._sketches, neardup._codes):
        assert sum(b.num_rows for b in made(iter([batch]))) == 2
        assert not neardup._known
    assert packing.CACHE_PARTS < tokens.CACHE_PARTS

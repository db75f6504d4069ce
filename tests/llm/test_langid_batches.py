"""A worker of the language stage holds few texts at once."""

import pyarrow as pa

from loomtext.llm import langid


def test_small_batches_keep_rows():
    given = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["i"]) for n in (0, 3, 1000)]
    got = list(langid._small(given))
    assert max(b.num_rows for b in got) <= 256 and [x for b in got for x in b.column(0).to_pylist()] == [*range(3), *range(1000)]

"""A worker of the decontamination stage makes arrays of few texts at once."""

import tracemalloc

import pyarrow as pa

from loomtext.llm import decontam


class Rows:
    """A table whose mapInArrow runs here, over one batch of many texts."""

    columns, schema = ["text"], None

    def __init__(self, batch):
        self.batch = batch
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, run, schema):
        return list(run([self.batch]))


def test_a_pass_holds_few_texts_at_once():
    item = " ".join(f"i{i}" for i in range(12))
    texts = [" ".join(f"w{n}x{i}" for i in range(400)) + (f" {item}" if n % 100 == 7 else "") for n in range(2000)]
    rows = Rows(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    tracemalloc.start()
    clean = decontam._clean_pass(rows, [("a", item)], 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in clean) == 1980
    assert peak < 40e6, peak

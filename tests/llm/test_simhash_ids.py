"""SimHash dedup where two different texts carry one id."""

from loomtext.llm import simhash


def test_other_text_of_a_dropped_id_stays(spark):
    rows = [(1, "one two three four five six"), (2, "One two three four five six"), (2, "quite another text that has nothing in common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [rows[0], rows[2]]

"""A text in more than three sources of a mix can be given to any of them."""

from __future__ import annotations

from loomcanvas.llm import mixing


def test_text_of_four_sources_goes_to_the_one_that_needs_it(spark):
    shared, own = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(i, shared, s) for i, s in enumerate("abcd")] + [(9, own, "d")], "doc_id long, text string, source string")
    rows = [("m", s, 0.0001, 1, 1.0) for s in "abc"] + [("m", "d", 0.9, 1, 1.0)]
    targets = spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int, corpus_fraction double")
    got = mixing.mix(docs, targets).collect()
    assert sorted((r.source, r.doc_id, r.repeats) for r in got) == [("d", 3, 1), ("d", 9, 1)]

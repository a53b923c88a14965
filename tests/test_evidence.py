"""Evidence of labels: the sentence that holds the label, and documents shared by both labels."""

import pytest

from termforest.operators import relations as R


def test_evidence_is_the_sentence_of_the_label(spark):
    far = "Nothing of use is said here. " * 40
    rows = [("c1", "d1", 0, far + "Energy storage such as flow battery is common. The end.", "en"), ("c2", "d1", 1, "Flow battery again.", "en"), ("c3", "d2", 0, far + "A flow battery alone.", "en"), ("c4", "d2", 1, "Then energy storage alone.", "en")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, lang string")
    labels = spark.createDataFrame([("energy storage",), ("flow battery",)], "term string")
    snippets = R.evidence_snippets(chunks, labels, 2)
    got = {(r["term"], r["rank"]): (r["document_id"], r["snippet"]) for r in snippets.collect()}
    said = "Energy storage such as flow battery is common."
    assert got == {("energy storage", 1): ("d1", said), ("energy storage", 2): ("d2", "Then energy storage alone."), ("flow battery", 1): ("d1", said), ("flow battery", 2): ("d2", "A flow battery alone.")}
    one = R.directional_evidence(spark.createDataFrame([("energy storage", "flow battery")], "parent string, child string"), snippets).first()
    assert (one["hits"], one["contra"]) == (2, 0) and one["evidence"] == pytest.approx(0.6 * 2 / 3 + 0.4)

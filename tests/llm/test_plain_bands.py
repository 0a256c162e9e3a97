"""Copies that only their plain shingle sets show are compared."""

from collections import defaultdict

from recordloom.llm import neardup


def test_copies_with_a_line_repeated(spark):
    rows = [(1000 + k, " ".join(f"f{k}w{i}" for i in range(20))) for k in range(400)]
    for k in range(20):
        words = [f"g{k}w{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + 20 * words[-14:]))]
    classes = defaultdict(set)
    for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        classes[r["class_id"]].add(r["doc_id"])
    assert all(classes[2 * k] == {2 * k, 2 * k + 1} for k in range(20))

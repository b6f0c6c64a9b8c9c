"""Ranking by rules against plain Python."""

from pyspark.sql import functions as F

from docuplane.functions import text as X
from docuplane.operators import rules as R

ROWS = [("a", "report harbour", "insured vessel"), ("b", "x", "the insured harbour report"), ("c", "x", "insurd harbor of the report"), ("d", "x", "nothing"), ("e", "harbour", None), ("f", "x", "report a b c d e f g h i harbour insured"), ("g", "x", "insured harbour report twice")]


def test_order(spark):
    t = spark.createDataFrame(ROWS, "doc_id string, p string, c string")
    terms = ["insured", "harbour", "report"]
    got = R.rule_ranks(t, terms, [X.tokens(F.col("p")), X.tokens(F.col("c"))]).orderBy(*R.rule_order()).collect()
    assert [r.doc_id for r in got] == ["b", "g", "a", "f", "c", "e"]
    f = {r.doc_id: (r.words, r.typos, r.proximity, r.attribute, r.exactness) for r in got}
    assert f["b"] == (3, 0, 2, 1, 3) and f["c"] == (3, 2, 16, 1, 1) and f["e"] == (1, 0, 16, 0, 1) and f["a"] == (3, 0, 9, 0, 3)
    assert [R.allowed_typos(w) for w in ("abcd", "abcde", "abcdefghi")] == [0, 1, 2]

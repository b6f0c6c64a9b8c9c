"""Replies of an extraction service, by example."""

import json

from docuplane.operators import index as I
from docuplane.sources import replies as R


def test_reply_parts(spark):
    reply = [
        {"X-TIKA:content": " whole ", "Content-Type": "application/zip", "n": 3, "none": None},
        {"X-TIKA:content": "inner", "X-TIKA:embedded_resource_path": "/a.zip/b.txt", "dc:creator": ["A", "B"], "resourceName": "b.txt"},
        {"X-TIKA:content": "no path"},
        {"X-TIKA:embedded_resource_path": "/1/2/3/deep.txt", "X-TIKA:content": "deep"},
    ]
    rows = [("/in/f.zip", json.dumps(reply)), ("/in/empty", "[]"), ("/in/broken", "{nothing"), ("/in/null", None), ("/in/list", "[1]")]
    got = {(r.source_path, r.part): r for r in R.reply_parts(spark.createDataFrame(rows, "source_path string, reply string"), max_depth=3).collect()}
    assert len(got) == 8
    top, inner, lost, deep = (got["/in/f.zip", i] for i in range(4))
    assert (top.display_path, top.extracted_from, top.content, top.error_type) == ("/in/f.zip", "", " whole ", None) and top.metadata == {"Content-Type": ["application/zip"], "n": ["3"]}
    assert (inner.display_path, inner.extracted_from, inner.metadata["dc:creator"]) == ("/in/f.zip/a.zip/b.txt", "/in/f.zip/a.zip", ["A", "B"])
    assert (lost.display_path, lost.extracted_from) == ("/in/f.zip/embedded-2", "/in/f.zip") and (deep.error_type, deep.content) == ("DepthLimitExceeded", "")
    assert got["/in/empty", 0].error_type == "EmptyExtraction" and {got[p, 0].error_type for p in ("/in/broken", "/in/null", "/in/list")} == {"ExtractionError"}
    assert R.reply_parts(spark.createDataFrame([], "source_path string, reply string")).count() == 0


def test_entries_find_their_parts(spark):
    parts = spark.createDataFrame([("/z", 0, "/z"), ("/z", 1, "/z/d/a.txt"), ("/z", 2, "/z/b.txt"), ("/z", 3, "/z/e/a.txt")], "source_path string, part int, display_path string")
    entries = spark.createDataFrame([("/z", 1, "d/a.txt"), ("/z", 2, "x/b.txt"), ("/z", 3, "q/a.txt"), ("/z", 4, "none"), ("/y", 1, "b.txt")], "source_path string, place int, name string")
    assert {(r.source_path, r.place): r.part for r in R.entry_parts(parts, entries).collect()} == {("/z", 1): 1, ("/z", 2): 2, ("/z", 3): None, ("/z", 4): None, ("/y", 1): None}


def test_truncation_is_recorded(spark):
    raw = spark.createDataFrame([("p", "p", " abc \n"), ("q", "q", "abcdef"), ("r", "r", None)], "source_path string, display_path string, content string")
    assert [(r.source_path, r.message) for r in I.truncated(raw, 3).collect()] == [("q", "q: 6 characters cut to 3")] and I.truncated(raw, 0).count() == 0


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "doc_id string, n int, v string")
    new = spark.createDataFrame([("b", 5, "p"), ("b", 9, "q"), ("c", 2, "r"), ("c", 2, "r")], "doc_id string, n int, v string")
    assert sorted(map(tuple, I.upsert(old, new, order=("n",)).collect())) == [("a", 1, "x"), ("b", 9, "q"), ("c", 2, "r")]
    assert {(r.doc_id, r.outcome) for r in I.outcomes(old, new.union(spark.createDataFrame([(None, 0, "")], new.schema))).collect()} == {("b", "updated"), ("c", "created"), (None, "refused")}

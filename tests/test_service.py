"""A store from files to answers."""

import pytest

from docuplane import cli, service as A
from docuplane.functions.vectors import HashingEmbedder
from docuplane.operators.search import SearchRequest
from docuplane.sources.store import Store
from tests.test_store import folder


def test_whole_way(spark, tmp_path):
    root, app = folder(tmp_path), A.Service(Store(spark, str(tmp_path / "store")))
    job = app.ingest("ix", root)
    row = app.log.jobs().where(f"job_id = '{job}'").first()
    assert row.status == "completed" and row.total_files == row.extracted == 6 and row.failed == 1 and row.finished_at is not None
    assert {r.error_type for r in app.log.errors(job).collect()} == {"EmptyExtraction", "UnpackError"}
    again = app.ingest("ix", root, resume=True)
    assert app.log.jobs().where(f"job_id = '{again}'").first().skipped == 6
    found = app.search(SearchRequest("harbour permit", ["ix"]))
    assert found.total == 1 and found.rows[0]["display_path"] == "a.txt" and "<mark>harbour</mark>" in found.rows[0]["snippet"]
    assert found.facets["File Type"] == ["text/plain"] and found.facets["Document Type"] == ["Parent Document"]
    assert app.search(SearchRequest("harbour", ["gone"])).total == 0
    with pytest.raises(ValueError):
        app.search(SearchRequest("harbour", ["ix"]), HashingEmbedder(8))
    e = HashingEmbedder(8)
    assert app.embed("ix", e, "m") > 0 and app.embed("ix", e, "m") == 0
    with pytest.raises(ValueError):
        app.embed("ix", HashingEmbedder(16), "n")
    assert app.embed("ix", HashingEmbedder(16), "n", force=True) > 0
    for ratio in (None, 0.3):
        both = app.search(SearchRequest("harbour permit", ["ix"], limit=3), HashingEmbedder(16), ratio)
        assert both.rows and both.total == 1
    zipped = next(r for r in app.store.docs("ix").collect() if r.display_path == "outer.zip")
    doc = app.document("ix", zipped.doc_id)
    assert [k["display_path"] for k in doc["attachments"]] == ["outer.zip/y.txt"] and doc["parent"] is None and app.document("ix", "no") is None
    inner = next(r for r in app.store.docs("ix").collect() if r.display_path == "outer.zip/y.txt")
    assert app.document("ix", inner.doc_id)["parent"]["doc_id"] == zipped.doc_id
    here = ["--store", str(tmp_path / "store")]
    assert cli.run([*here, "indices"], spark) == [{"index": "ix", "documents": app.store.docs("ix").count(), "embedded": True}]
    assert cli.run([*here, "search", "permit", "--index", "ix", "--created-to", "1990"], spark)["total"] == 0
    assert len(cli.run([*here, "jobs"], spark)) == 2 and cli.run([*here, "reset", "ix"], spark) == {"reset": "ix"} and cli.run([*here, "indices"], spark) == []


def test_arguments():
    a = cli.parser().parse_args(["search", "x", "--index", "a, b", "--created-from", "2001", "--created-to", "2003", "--sort", "size:asc", "--filter", "File Type=PDF"])
    r = cli.request(a)
    assert (r.indices, r.filters, r.sort) == (["a", "b"], {"File Type": ["PDF"], "Created": ["from:2001", "to:2003"]}, ("size", False))
    assert A.retry_scope("empty") == {"only": "EmptyExtraction"} and A.retry_scope(None, True) == {}
    with pytest.raises(ValueError):
        A.retry_scope(None)
    assert A.previewable("application/pdf; x=y") and not A.previewable("text/html") and not A.previewable("made/up")


def test_retry_limit_and_reset(spark, tmp_path):
    here = ["--store", str(tmp_path / "store")]
    assert cli.run([*here, "init"], spark)["made"]
    root = tmp_path / "in"
    root.mkdir()
    for i in range(3):
        (root / f"f{i}.txt").write_text("harbour " * (i * 4) or " ")
    app = A.Service(Store(spark, str(tmp_path / "store")), max_chars=40)
    first = app.ingest("ix", str(root), limit=2)
    assert app.log.jobs().first().total_files == 2
    job = app.ingest("ix", str(root))
    assert {(r.file_path.rsplit("/", 1)[1], r.error_type) for r in app.log.errors(job).collect()} == {("f0.txt", "EmptyExtraction"), ("f2.txt", "ContentTruncated")}
    assert app.log.jobs().where(f"job_id = '{job}'").first().failed == 0
    (root / "f0.txt").write_text("now it says something")
    again = app.retry(job, "empty")
    assert cli.run([*here, "job", again], spark)["total_files"] == 1 and cli.run([*here, "job", again], spark)["job_type"] == "retry"
    assert app.store.docs("ix").where("content like 'now it%'").count() == 1
    with pytest.raises(ValueError):
        app.retry("none", "empty")
    other = app.ingest("iy", str(root))
    app.reset("ix")
    assert [r.job_id for r in app.log.jobs().collect()] == [other] and app.log.errors(first).count() == 0 and app.store.indices() == ["iy"]

"""Files to rows and back."""

import os
import zipfile

from docuplane.functions.vectors import HashingEmbedder
from docuplane.sources import files as S
from docuplane.sources.config import Config
from docuplane.sources.store import Store, count_only
from docuplane.streaming import ingest as G


def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("harbour permit\n\n\n\nend")
    (root / "sub" / "b.html").write_text("<p>x</p>")
    (root / "empty.txt").write_text("  ")
    (root / "bad.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(root / "inner.zip", "w") as z:
        z.writestr("deep.txt", "deep text")
    with zipfile.ZipFile(root / "outer.zip", "w") as z:
        z.write(root / "inner.zip", "d/inner.zip")
        z.writestr(".hidden", "h")
        z.writestr("__TEXT__", "t")
        z.writestr("x.metadata.json", "{}")
        z.writestr("dir/", "")
        z.writestr("y.txt", "why")
    os.remove(root / "inner.zip")
    (root / "m.eml").write_bytes(b"From: A <a@x.org>\r\nTo: b@x.org\r\nMessage-ID: <1@x>\r\nSubject: s\r\n\r\nhello\r\n")
    return str(root)


def test_extract(spark, tmp_path):
    root = folder(tmp_path)
    parts = S.extract(S.walk(spark, root)).collect()
    shown = {r.display_path.removeprefix(root + "/"): r for r in parts}
    assert {"a.txt", "sub/b.html", "outer.zip", "outer.zip/d/inner.zip", "outer.zip/d/inner.zip/deep.txt", "outer.zip/y.txt", "m.eml"} <= set(shown)
    assert not any(".hidden" in k or "__TEXT__" in k or "metadata" in k for k in shown)
    assert {r.error_type for r in parts} == {None, "EmptyExtraction", "UnpackError"}
    shallow = S.extract(S.walk(spark, root), max_depth=1).collect()
    assert "DepthLimitExceeded" in {r.error_type for r in shallow}
    assert S.listed(spark, [f"{root}/a.txt", f"{root}/gone"]).count() == 1 and S.listed(spark, []).count() == 0


def test_ingest_embed_and_writes(spark, tmp_path):
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        G.ingest_stream(spark, store, root, "ix", str(tmp_path / "cp"), root).awaitTermination()
    docs = store.docs("ix")
    n = docs.count()
    assert store.indices() == ["ix"] and n == docs.select("doc_id").distinct().count() >= 7
    assert docs.where("display_path = 'a.txt'").first().content == "harbour permit\n\nend"
    assert G.embed_index(store, "ix", HashingEmbedder(8)) >= n and store.unembedded("ix").count() == 0
    one = docs.where("display_path = 'a.txt'").drop("index_name")
    store.put(one, "ix")
    assert store.docs("ix").count() == n and store.unembedded("ix").count() == 1
    store.clear_chunks("ix")
    assert store.unembedded("ix").count() == n and count_only(store.docs("ix")) == n
    assert S.without_indexed(S.walk(spark, root), store.docs("ix")).count() == 0
    assert store.create("ix", dict(store.docs("ix").drop("index_name").dtypes)) is False and store.create("ix", {"doc_id": "bigint"}) is True
    store.delete("ix")
    store.delete("ix")
    assert store.indices() == [] and store.docs() is None


def test_email_html():
    raw = b'MIME-Version: 1.0\nContent-Type: multipart/related; boundary=b\n\n--b\nContent-Type: text/html\n\n<img src="cid:i1">\n--b\nContent-Type: image/png\nContent-ID: <i1>\nContent-Transfer-Encoding: base64\n\nAAAA\n--b--\n'
    assert S.email_html(raw).strip() == '<img src="data:image/png;base64,AAAA">'
    assert S.email_html(b"Subject: x\n\na < b\n") == "<pre>a &lt; b\n</pre>"


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("batch_size = 5\nembed_batch = 7\n")
    c = Config.load(str(f), {"DOCUPLANE_EMBED_BATCH": "9"})
    assert (c.batch_size, c.embed_batch, c.max_extract_depth) == (5, 9, 5)


def test_streaming_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "a", 2.0), (2, "2024-01-01 00:50:00", 1, "a", 3.0), (3, "2024-01-01 03:00:00", 2, "b", 1.0), (1, "2024-01-01 00:10:00", 1, "a", 2.0)], "event_id bigint, t string, user_id bigint, event_type string, value double").selectExpr("event_id", "to_timestamp(t) ts", "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "ev"))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    q = G.event_windows(G.first_deliveries(stream), late=None).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.table("win").collect()] == [("a", 2, 5.0)]


def test_deltas_give_the_rows_of_whole_rewrites(spark, tmp_path):
    import random

    from docuplane.sources import store as S

    rng, store, truth, vectors = random.Random(8), S.Store(spark, str(tmp_path / "s")), {}, {}
    for step in range(12):
        ids = rng.sample(range(40), rng.randrange(1, 9))
        rows = [(f"d{i}", f"t{step}") for i in ids]
        store.put(spark.createDataFrame(rows, "doc_id string, content string"), "ix")
        truth |= dict(rows)
        for d, _ in rows:
            vectors.pop(d, None)
        if step % 3 == 2:
            some = rng.sample(sorted(truth), 3)
            store.put_chunks(spark.createDataFrame([(d, c, [float(step)]) for d in some for c in range(2)], "doc_id string, chunk_no int, embedding array<float>"), "ix")
            vectors |= {d: {(0, float(step)), (1, float(step))} for d in some}
        assert {r.doc_id: r.content for r in store.docs("ix").collect()} == truth and len(truth) == store.docs("ix").count()
        got = {}
        for r in store.chunks("ix").collect() if step > 2 else []:
            got.setdefault(r.doc_id, set()).add((r.chunk_no, r.embedding[0]))
        assert step <= 2 or got == vectors
    assert len(store._deltas("ix", "docs")) < S.DELTAS

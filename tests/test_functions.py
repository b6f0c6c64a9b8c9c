"""Small functions by example."""

import pytest
from pyspark.sql import functions as F

from docuplane.functions import meta as M, text as X, vectors as V
from docuplane.operators import chunking as C, index as I, jobs as J, search as S


def value(spark, column, v, kind="string"):
    return spark.createDataFrame([(v,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("v, out", [(" <abc@example.com> ", "abc@example.com"), ("   ", ""), ("x", "x"), (None, None)])
def test_message_id(spark, v, out):
    assert value(spark, M.message_id, v) == out


@pytest.mark.parametrize("v, out", [("Alice <alice@example.com>", "alice@example.com"), ("a@b", "a@b"), ("", None), ("<>", None), ("Name <>", None), ("undisclosed-recipients:;", None), ("Recipients <undisclosed>", None), (None, None)])
def test_email(spark, v, out):
    assert value(spark, M.email_address, v) == out


@pytest.mark.parametrize("v, out", [("application/pdf", "PDF"), ("image/png", "PNG"), ("made/up", "made/up")])
def test_label(spark, v, out):
    assert value(spark, M.label_of, v) == out


@pytest.mark.parametrize("v, out", [("a\n\n\nb", "a\n\nb"), ("a\n \n\t\nb\n", "a\n\nb\n"), ("\n\n\na", "\na"), ("a\n \nb", "a\n\nb"), ("", ""), ("one", "one")])
def test_blank_lines(spark, v, out):
    assert value(spark, X.condense_blank_lines, v) == out


@pytest.mark.parametrize("v, out", [("a/b.txt", "b.txt"), ("b", "b"), ("a/..", None), ("a/.hidden", None), ("", None), ("a\0b", None), ("dir/", None)])
def test_entry_name(spark, v, out):
    assert value(spark, X.safe_entry_name, v) == out


@pytest.mark.parametrize("v, out", [("MyReport12345_finalV2.PDF", "my report 12345 final v 2 pdf"), ("HTTPServer-log.txt", "httpserver log txt"), ("", "")])
def test_path_tokens(spark, v, out):
    assert " ".join(value(spark, X.path_tokens, v)) == out


def test_curate(spark):
    rows = [
        ("/data/in/a.eml", 0, "text \n\n\n more ", {"Message-From": ["ALICE <Alice@Example.com>"], "Message-To": ["bob@example.com", "alice@example.com"], "Author": ["Al"], "dcterms:created": ["2023-06-15T10:00:00Z"], "Content-Type": ["text/html; charset=UTF-8"], "Content-Length": ["no"], "References": ["<a> <b>", "c"], "_docuplane_x": ["1"], "X-TIKA:content": ["x"]}, None, None),
        ("/data/in/z.zip", 1, None, {}, "/data/in/z.zip/y.txt", "/data/in/z.zip"),
        ("/else/w", 0, "", {"dc:creator": [], "Author": ["hidden"]}, None, "/else"),
    ]
    raw = spark.createDataFrame(rows, "source_path string, part int, content string, metadata map<string,array<string>>, display_path string, extracted_from string")
    a, b, c = sorted(I.curate(raw, "ix", "/data/in").collect(), key=lambda r: r.source_path)
    assert (a.creator, a.created_year, a.content_type, a.file_size, a.display_path) == ("Al", 2023, "text/html", None, "a.eml")
    assert a.email_addresses == ["alice@example.com", "bob@example.com"] and a.references == ["a", "b", "c"] and a.content == "text \n\n more"
    assert set(a.metadata) & {"_docuplane_x", "X-TIKA:content"} == set()
    assert (b.display_path, b.extracted_from, b.document_type, b.content) == ("z.zip/y.txt", "z.zip", "Attachment", "")
    assert c.creator is None and c.display_path == "w" and c.extracted_from == "" and c.document_type == "Parent Document"


@pytest.mark.parametrize(
    "text, most, overlap, out",
    [("", 100, 20, [""]), ("Para one.\n\nPara two.", 100, 20, ["Para one.\n\nPara two."]), ("A" * 10 + "\n\n" + "B" * 10 + "\n\n" + "C" * 10, 22, 0, ["A" * 10 + "\n\n" + "B" * 10, "C" * 10]), ("A" * 10 + "\n\n" + "B" * 10 + "\n\n" + "C" * 10, 22, 12, ["A" * 10 + "\n\n" + "B" * 10, "B" * 10 + "\n\n" + "C" * 10])],
)
def test_chunks(text, most, overlap, out):
    assert C.chunk_text(text, most, overlap) == out


def test_chunk_bytes():
    assert all(len(c.encode()) <= 20 for c in C.chunk_text("A" * 50, 20, 5) + C.chunk_text("漢字" * 20, 20, 5))
    assert C.split_sentences("Hello. World! How are you?") == ["Hello.", "World!", "How are you?"]
    assert C.chunk_text("漢" * 5, 1, 0) == ["漢"] * 5


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    x, z = df.select(V.l2_normalize(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(v, 6) for v in x.u] == [0.6, 0.8] and round(x.c, 6) == 0.96 and z.u == [0.0, 0.0] and z.c is None


def test_requests():
    assert S.parse_sort("date:desc") == ("date", True) and S.parse_sort(None) is None
    for bad in ("date", "name:asc", "size:up"):
        with pytest.raises(ValueError):
            S.parse_sort(bad)
    assert S.resolve_indices(" a, ,b") == ["a", "b"] and S.terms_of("The harbour, the HARBOUR 3.14") == ["the", "harbour", "3", "14"]
    with pytest.raises(ValueError):
        S.SearchRequest(limit=0).checked()
    assert not S.SearchRequest(offset=5).wants_facets and S.SearchRequest(offset=5, filters={"Creator": ["x"]}).wants_facets


def test_search_pages_are_the_whole(spark):
    rows = [("i", f"{k:03d}", f"harbour {'x ' * (k % 7)}permit", f"a/harbour{k}.txt", "text/plain", None, 2000 + k % 5, k if k % 3 else None, "Parent Document") for k in range(50)]
    t = spark.createDataFrame(rows, "index_name string, doc_id string, content string, display_path string, content_type string, creator string, created_year bigint, file_size bigint, document_type string")
    hits = S.content_score(t, "harbour permit").select("doc_id", "score", "file_size")
    whole = [r.doc_id for r in S.ordered(hits, None).collect()]
    assert whole == [r.doc_id for o in range(0, 50, 20) for r in S.page(hits, None, 20, o).collect()] and len(whole) == 50
    sized = [r.file_size for r in S.ordered(hits, ("size", True)).collect()]
    assert sized[-17:] == [None] * 17
    page = S.search(t, S.SearchRequest("harbour permit", ["i"], limit=5, filters={"Created": ["from:2002", "to:2003"]})).collect()
    assert len(page) == 5 and "<mark>harbour</mark>" in page[0].snippet
    assert S.search(t, S.SearchRequest("harbour permit", ["none"])).count() == 0
    ids = {r.doc_id for r in S.matches(t, "").collect()}
    assert len(ids) == 50


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("z", 0.5)], "k string, score double")
    b = spark.createDataFrame([("z", 0.9), ("w", 0.1)], "k string, score double")
    ra, rb = S.ranked(a, 10, "k"), S.ranked(b, 10, "k")
    one, two = ({r.k: r.score for r in S.fuse_ranks(p, q, "k").collect()} for p, q in ((ra, rb), (rb, ra)))
    assert one == two and one["z"] == round(1 / 63 + 1 / 61, 6)


def test_access(spark):
    idx = spark.createDataFrame([("a",), ("b",)], "index_name string")
    per = spark.createDataFrame([("u", "a"), ("v", "*")], "user_name string, index_name string")
    names = lambda *x, **k: sorted(r[0] for r in J.visible_indices(idx, per, *x, **k).collect())
    assert names("u") == ["a"] and names("v") == ["a", "b"] and names("w") == [] and names("w", admin=True) == ["a", "b"]
    reg = spark.createDataFrame([("a", "m", "o"), ("b", "n", "o")], "index_name string, model string, backend string")
    assert S.one_model(reg, ["a"]) == ("m", "o")
    for bad in (["a", "b"], ["c"]):
        with pytest.raises(ValueError):
            S.one_model(reg, bad)
    assert J.embed_guard(None, ("m", "o", 3)) is False and J.embed_guard(("x", "o", 3), ("m", "o", 3), force=True)
    with pytest.raises(ValueError):
        J.embed_guard(("x", "o", 3), ("m", "o", 3))


def test_rate_key(spark):
    assert value(spark, J.rate_key, "10.0.0.1") == "10.0.0.1" and value(spark, J.rate_key, "2001:db8:1:2:3::4") == "2001:db8:1:2"


def test_batches_are_greedy(spark):
    rows = spark.createDataFrame([("g", k, s) for k, s in enumerate([5, 5, 1, 20, 3, 3, 3])], "g string, k bigint, s bigint")
    got = {r.k: r.batch for r in C.payload_batches(rows, "g", "k", "s", 10).collect()}
    groups = {}
    for k, b in got.items():
        groups.setdefault(b, []).append(k)
    assert sorted(sorted(v) for v in groups.values()) == [[0, 1], [2], [3], [4, 5, 6]]


def test_sanitised_html(spark):
    from docuplane.functions import text as X

    cases = {
        "<p onclick='x()'>a</p>": "<p>a</p>", "<script>bad()</script>b": "b", "<SCRIPT src=x>": "", '<a href="javascript:x()">c</a>': "<a>c</a>", '<a href="https://h.example/">d</a>': '<a href="https://h.example/">d</a>', "<img src=x onerror=y>": "<img>",
        '<img src="data:image/png;base64,AA==">': '<img src="data:image/png;base64,AA==">', "<iframe><p>e</p></iframe>f<!-- <script> -->": "f", '<a href=" java&#115;cript:x()">g</a>': "<a>g</a>", "<form><input name=x></form>": "", "": "", None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    got = {r.h: r.s for r in df.select("h", X.sanitise_html(df.h).alias("s")).collect()}
    assert got == cases


def test_chunks_of_long_parts():
    assert C.chunk_text("  Para one.  \n\n\n Para two. ", 100, 20) == ["Para one.\n\nPara two."] and C.chunk_text(" \n\n ", 100, 20) == [" \n\n "]
    sentences = " ".join(x * 10 + "." for x in "ABC")
    assert C.chunk_text(sentences, 22, 12)[0] == "A" * 10 + "." and C.chunk_text(sentences, 22, 12)[1].startswith("A" * 10 + ". B")
    # the overlap of what stands before an oversized paragraph waits for what stands behind it
    assert C.chunk_text("aa\n\nbb\n\n" + "x" * 12 + "\n\ncc", 8, 2) == ["aa\n\nbb", "x" * 8, "x" * 6, "bb\n\ncc"]
    assert C.chunk_text("A" * 50, 20, 5) == ["A" * 20, "A" * 20, "A" * 20, "A" * 5] and C.chunk_text("A" * 9, 4, 4) == ["A" * 4, "A" * 4, "A"]


def test_batches_count_what_stands_between(spark):
    rows = spark.createDataFrame([("g", k, 4) for k in range(4)] + [("h", 9, 99)], "g string, k bigint, s bigint")
    got = {(r.g, r.k): r.batch for r in C.payload_batches(rows, "g", "k", "s", 12, per_row=1, per_batch=2).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 1, ("h", 9): 0}

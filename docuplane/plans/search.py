"""Queries of search: filters, ranking, vectors, facets, sorting, paging, related documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuplane.functions import meta as M, text as X
from docuplane.operators import index as I, related as R, search as S
from docuplane.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark, d, *more: str):
    """The live rows with the typed columns that filters, facets and sorts use."""
    need = ["index_name", "content_type", "creator", "created", "file_size", "extracted_from", "display_path", "has_embeddings", *more]
    t = I.live(table(spark, d, "index_docs").select("doc_id", "row_id", "indexed_at", *dict.fromkeys(need)), *dict.fromkeys(need))
    return t.withColumns({"content_type": M.mime_base(F.col("content_type")), "created_year": M.year_of(F.col("created")), "file_size": M.whole_number(F.col("file_size")), "document_type": M.document_type(F.col("extracted_from"))})


def scored(spark, d, terms: list[str], boosts: dict[str, float]):
    """The live rows that match, scored. Term figures are taken before the last version of each row is chosen, so that no text goes
    through that shuffle."""
    need = ["index_name", "content_type", "created", "file_size", "extracted_from", "display_path"]
    t = S.term_figures(table(spark, d, "index_docs").select("doc_id", "row_id", "indexed_at", "content", *need), terms, {f: c for f, c in S.field_tokens().items() if f in boosts})
    t = I.live(t.drop("content"), *need, *[f"__{x}_{f}" for f in boosts for x in ("l", "tf")])
    return S.score_figures(t.withColumn("content_type", M.mime_base(F.col("content_type"))), terms, boosts)


LIVE = r"""live AS (SELECT doc_id, index_name, trim(split_part(content_type, ';', 1)) AS content_type, creator, created, CASE WHEN length(created) >= 4 AND regexp_full_match(substr(created, 1, 4), '[+-]?[0-9]+') THEN try_cast(substr(created, 1, 4) AS BIGINT) END AS created_year,
 CASE WHEN regexp_full_match(file_size, '[+-]?[0-9]+') THEN try_cast(file_size AS BIGINT) END AS file_size, extracted_from, display_path, has_embeddings, content, CASE WHEN coalesce(extracted_from, '') = '' THEN 'Parent Document' ELSE 'Attachment' END AS document_type
 FROM index_docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC, row_id DESC) = 1)"""

TERMS = ["insured", "harbour"]
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_PATH = rf"list_transform(regexp_extract_all(display_path, '{X.PATH_TOKEN}'), lambda x: lower(x))"


def _bm25_sql(fields: dict[str, tuple[str, float]], terms: list[str]) -> str:
    """SELECT doc_id, score ... of the rows with all terms in a field; needs the view live."""
    count = lambda f, w: f"CAST(len(list_filter(t_{f}, lambda x: x = '{w}')) AS BIGINT)"
    toks = ", ".join(f"{e} AS t_{f}" for f, (e, _) in fields.items())
    tfs = ", ".join([f"len(t_{f}) AS l_{f}" for f in fields] + [f"{count(f, w)} AS tf_{f}_{i}" for f in fields for i, w in enumerate(terms)])
    stats = ", ".join([f"avg(l_{f}) AS avg_{f}" for f in fields] + [f"count_if(tf_{f}_{i} > 0) AS df_{f}_{i}" for f in fields for i in range(len(terms))])
    every = {f: " AND ".join(f"tf_{f}_{i} > 0" for i in range(len(terms))) for f in fields}
    part = lambda f, i: f"ln(1 + (n - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * tf_{f}_{i} / (tf_{f}_{i} + 1.2 * (1 - 0.75 + 0.75 * l_{f} / avg_{f}))"
    score = " + ".join(f"CASE WHEN {every[f]} THEN CAST({b} AS DOUBLE) * ({' + '.join(part(f, i) for i in range(len(terms)))}) ELSE 0 END" for f, (_, b) in fields.items())
    return f"(SELECT tf.*, round({score}, 6) AS score FROM (SELECT *, {tfs} FROM (SELECT *, {toks} FROM live)) tf, (SELECT count(*) AS n, {stats} FROM (SELECT {tfs} FROM (SELECT {toks} FROM live))) st WHERE {' OR '.join(f'({e})' for e in every.values())})"


_BM1 = _bm25_sql({"content": (_TOK, 1.0)}, TERMS)
_BM2 = _bm25_sql({"content": (_TOK, 1.0), "path": (_PATH, 2.0)}, ["report", "insurer"])


@query(f"WITH {LIVE} SELECT doc_id, score FROM {_BM1}")
def bm25_and(spark, d):
    return scored(spark, d, TERMS, {"content": 1.0}).select("doc_id", "score")


@query(f"WITH {LIVE} SELECT doc_id, score FROM {_BM2}")
def bm25_two_field(spark, d):
    return scored(spark, d, S.terms_of("report insurer"), S.TEXT_FIELDS).select("doc_id", "score")


@query(f"WITH {LIVE} SELECT doc_id, score FROM {_BM1} WHERE index_name IN ('quay_ledger', 'delta_permits', 'northgate_mail') AND content_type = 'application/pdf' ORDER BY score DESC, doc_id LIMIT 20")
def search_page(spark, d):
    hit = scored(spark, d, TERMS, {"content": 1.0}).where(F.col("index_name").isin("quay_ledger", "delta_permits", "northgate_mail")).where(S.filter_column({"File Type": ["PDF"]}))
    return S.page(hit, None, 20).select("doc_id", "score")


@query(f"WITH {LIVE} SELECT doc_id, score FROM {_BM1} ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def page_offset(spark, d):
    hit = scored(spark, d, TERMS, {"content": 1.0})
    return S.page(hit.select("doc_id", "score"), None, 10, 10)


@query(f"WITH {LIVE} SELECT index_name, doc_id, score FROM {_BM1} WHERE index_name IN ('quay_ledger', 'koto_freight') ORDER BY score DESC, doc_id LIMIT 25")
def multi_index_topk(spark, d):
    hit = scored(spark, d, TERMS, {"content": 1.0})
    parts = [hit.where(F.col("index_name") == i).select("index_name", "doc_id", "score") for i in ("quay_ledger", "koto_freight")]
    return S.page(parts[0].unionByName(parts[1]), None, 25)


@query(f"WITH {LIVE} SELECT count(*) AS n FROM {_bm25_sql({'content': (_TOK, 1.0), 'path': (_PATH, 2.0)}, TERMS)}")
def count_hits(spark, d):
    t = table(spark, d, "index_docs").select("doc_id", "row_id", "indexed_at", S.has_terms("insured harbour").alias("hit"))
    return I.live(t, "hit").where("hit").agg(F.count("*").alias("n"))


@query()
def bm25_postings(spark, d):
    """The same ranking as bm25_and from a written, bucketed postings table."""
    from docuplane.session import Scratch

    t = rows(spark, d, "content")
    scratch = Scratch(spark, "postings")
    p = S.postings(t)
    path = f"{scratch.root}/postings"
    p.write.partitionBy("bucket").parquet(path)
    st = t.select(F.size(X.tokens(F.col("content"))).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("a")).first()
    return S.score_postings(spark.read.parquet(path), st["n"], st["a"], TERMS)


SQL["bm25_postings"] = SQL["bm25_and"]


# filters


@query(f"WITH {LIVE} SELECT doc_id FROM live WHERE content_type IN ('application/pdf', 'text/html') AND document_type = 'Attachment'")
def filter_and_of_or(spark, d):
    return rows(spark, d).where(S.filter_column({"File Type": ["PDF", "HTML"], "Document Type": ["Attachment"], "Unknown": ["x"], "Creator": []})).select("doc_id")


@query(f"WITH {LIVE} SELECT doc_id FROM live WHERE created_year >= 2015 AND created_year <= 2018")
def filter_year_range(spark, d):
    return rows(spark, d).where(S.filter_column({"Created": ["from:2015", "to:2018", "soon"]})).select("doc_id")


@query(f"WITH {LIVE} SELECT doc_id FROM live WHERE content_type IN ('application/msword', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document')")
def filter_type_alias(spark, d):
    return rows(spark, d).where(S.filter_column({"File Type": ["Word"]})).select("doc_id")


@query("WITH a AS (SELECT unnest(email_to) AS x FROM mail_docs) SELECT doc_id FROM mail_docs WHERE list_has_any(email_to, [(SELECT min(x) FROM a), (SELECT max(x) FROM a)])")
def filter_email_any(spark, d):
    t = table(spark, d, "mail_docs").select("doc_id", F.col("email_to").alias("email_addresses"))
    ends = t.select(F.explode("email_addresses").alias("x")).agg(F.min("x"), F.max("x")).first()
    return t.where(S.filter_column({"Email Addresses": [x for x in ends if x is not None]})).select("doc_id")


# vectors: every 50th row asks, all rows answer


_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"


def _asking(t):
    return t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"SELECT query_id, key, score, place FROM (SELECT q.vec_id AS query_id, e.vec_id AS key, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 10")
def knn_topk(spark, d):
    t = table(spark, d, "embeddings")
    return S.knn(t, _asking(t), 10)


@query(f"SELECT query_id, key, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id // 2 AS key, max({_COS}) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 GROUP BY ALL)) WHERE place <= 10")
def knn_max_chunk(spark, d):
    t = table(spark, d, "embeddings")
    return S.knn(t, _asking(t), 10, group=F.expr("vec_id div 2"))


@query(f"SELECT query_id, key, score, place FROM (SELECT q.vec_id AS query_id, e.vec_id AS key, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.label % 2 = 0) WHERE place <= 10")
def knn_filtered(spark, d):
    t = table(spark, d, "embeddings")
    return S.knn(t.where("label % 2 = 0"), _asking(t), 10)


_DOCS = "live AS (SELECT doc_id, text AS content FROM documents)"
_KW = _bm25_sql({"content": (_TOK, 1.0)}, ["harbour"])
_KWTOP = f"kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM {_KW} QUALIFY place <= 50)"
_VECTOP = f"vec AS (SELECT e.vec_id AS doc_id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS place FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 100) q QUALIFY place <= 50)"


def _branches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    kw = S.ranked(S.bm25(docs, ["harbour"], {"content": (X.tokens(F.col("content")), 1.0)}), 50, "doc_id")
    t = table(spark, d, "embeddings")
    vec = S.knn(t, _asking(t).where("query_id = 100"), 50).select(F.col("key").alias("doc_id"), "score", "place")
    return kw, vec


@query(f"WITH {_DOCS}, {_KWTOP}, {_VECTOP} SELECT coalesce(kw.doc_id, vec.doc_id) AS doc_id, round(coalesce(1.0 / (60 + kw.place), 0) + coalesce(1.0 / (60 + vec.place), 0), 6) AS score FROM kw FULL JOIN vec ON kw.doc_id = vec.doc_id")
def hybrid_rrf(spark, d):
    kw, vec = _branches(spark, d)
    return S.fuse_ranks(kw, vec, "doc_id")


@query(f"WITH {_DOCS}, {_KWTOP}, {_VECTOP}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM kw) SELECT coalesce(kw.doc_id, vec.doc_id) AS doc_id, round(0.5 * coalesce(CASE WHEN hi > lo THEN (kw.score - lo) / (hi - lo) ELSE 1 END, 0) * (CASE WHEN kw.doc_id IS NULL THEN 0 ELSE 1 END) + 0.5 * coalesce((1 + vec.score) / 2, 0), 6) AS score FROM (kw FULL JOIN vec ON kw.doc_id = vec.doc_id), b")
def hybrid_weighted(spark, d):
    kw, vec = _branches(spark, d)
    return S.fuse_weighted(kw, vec, "doc_id", 0.5)


# facets


_FACETS = f"WITH {LIVE}, pairs AS (SELECT 'Created' AS facet, CAST(created_year AS VARCHAR) AS value FROM live UNION ALL SELECT 'File Type', content_type FROM live UNION ALL SELECT 'Document Type', document_type FROM live UNION ALL SELECT 'Creator', creator FROM live), c AS (SELECT facet, value, count(*) AS n FROM pairs WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"{_FACETS} SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 100")
def facets_one_pass(spark, d):
    return S.facet_counts(rows(spark, d))


@query(f"{_FACETS} SELECT value, n FROM c WHERE facet = 'Creator' QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 100")
def facet_terms(spark, d):
    return S.facet_counts(rows(spark, d), {"Creator": "creator"}).select("value", "n")


@query(f"{_FACETS} SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 10")
def facet_top10(spark, d):
    return S.facet_counts(rows(spark, d), top=10)


@query(f"WITH {LIVE} SELECT created_year AS y, count(*) AS n FROM live WHERE created_year IS NOT NULL GROUP BY 1")
def facet_year(spark, d):
    return rows(spark, d).where("created_year is not null").groupBy(F.col("created_year").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT value, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(email_to) AS value FROM mail_docs) GROUP BY value QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 100")
def facet_email_explode(spark, d):
    t = table(spark, d, "mail_docs").select(F.col("email_to").alias("email_addresses"))
    return S.facet_counts(t, {"Email Addresses": "email_addresses"}).select("value", "n")


@query(f"WITH {LIVE} SELECT value, count(*) AS n FROM (SELECT content_type AS value FROM live WHERE index_name IN ('quay_ledger', 'delta_permits')) WHERE value IS NOT NULL GROUP BY value")
def facet_merge_multi(spark, d):
    t = rows(spark, d)
    parts = [S.facet_counts(t.where(F.col("index_name") == i), {"File Type": "content_type"}) for i in ("quay_ledger", "delta_permits")]
    return S.merge_facets(*parts).select("value", "n")


@query(f"{_FACETS}, top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 100) SELECT facet, array_to_string(list(value ORDER BY n DESC, value), '|') AS shown FROM top GROUP BY facet")
def facets_shown(spark, d):
    return S.shown_facets(S.facet_counts(rows(spark, d))).select("facet", F.array_join("shown_values", "|").alias("shown"))


# catalog, counts, sorting


@query("SELECT DISTINCT index_name FROM index_docs WHERE NOT starts_with(index_name, '.')")
def list_indices(spark, d):
    return table(spark, d, "index_docs").select("index_name").distinct().where(~F.col("index_name").startswith("."))


@query("SELECT index_name, count(DISTINCT doc_id) AS n FROM index_docs GROUP BY index_name")
def index_doc_counts(spark, d):
    return table(spark, d, "index_docs").select("index_name", "doc_id").distinct().groupBy("index_name").agg(F.count("*").alias("n"))


@query(f"WITH {LIVE} SELECT index_name, count_if(NOT coalesce(has_embeddings, false)) AS n FROM live GROUP BY index_name")
def count_unembedded(spark, d):
    return rows(spark, d).groupBy("index_name").agg(F.count_if(~F.coalesce("has_embeddings", F.lit(False))).alias("n"))


@query("SELECT doc_id, arg_max(row_id, (j, indexed_at, row_id)) AS row_id FROM (SELECT doc_id, row_id, indexed_at, job_id IN (SELECT job_id FROM jobs WHERE lower(trim(status)) = 'completed') AS j FROM index_docs) GROUP BY doc_id")
def upsert_last_wins(spark, d):
    """The rows of completed jobs put over those of all others."""
    t = table(spark, d, "index_docs").select("doc_id", "row_id", "indexed_at", "job_id")
    done = table(spark, d, "jobs").where("lower(trim(status)) = 'completed'").select("job_id")
    old, new = t.join(done, "job_id", "left_anti"), t.join(done, "job_id", "left_semi")
    order = ("indexed_at", "row_id")
    return I.upsert(I.upsert(old.limit(0), old, order=order), new, order=order).select("doc_id", "row_id")


@query(f"WITH {LIVE} SELECT doc_id, created FROM live ORDER BY created DESC NULLS LAST, doc_id LIMIT 50")
def sort_date_desc(spark, d):
    return S.page(rows(spark, d).select("doc_id", "created"), ("date", True), 50)


@query(f"WITH {LIVE} SELECT doc_id, file_size FROM live ORDER BY file_size ASC NULLS LAST, doc_id LIMIT 50")
def sort_size_asc(spark, d):
    return S.page(rows(spark, d).select("doc_id", "file_size"), ("size", False), 50)


@query(f"WITH {LIVE} SELECT doc_id FROM live WHERE NOT coalesce(has_embeddings, false) AND doc_id > '8' ORDER BY doc_id LIMIT 100")
def keyset_page(spark, d):
    return rows(spark, d).where(~F.coalesce("has_embeddings", F.lit(False))).where("doc_id > '8'").select("doc_id").orderBy("doc_id").limit(100)


# related documents


@query(f"WITH {LIVE}, p AS (SELECT index_name, display_path, min(doc_id) AS parent_id FROM live GROUP BY ALL) SELECT l.doc_id, p.parent_id FROM live l LEFT JOIN p ON p.index_name = l.index_name AND p.display_path = l.extracted_from WHERE l.extracted_from <> ''")
def parent_lookup(spark, d):
    return R.parents(rows(spark, d))


@query(f"WITH {LIVE} SELECT p.doc_id, count(*) AS n FROM live p JOIN live c ON c.index_name = p.index_name AND c.extracted_from = p.display_path GROUP BY p.doc_id")
def attachments(spark, d):
    t = rows(spark, d)
    kids = t.where("extracted_from <> ''").groupBy("index_name", F.col("extracted_from").alias("display_path")).agg(F.count("*").alias("n"))
    return t.join(kids, ["index_name", "display_path"]).select("doc_id", "n")


_IDS = r"ids AS (SELECT DISTINCT doc_id, index_name, m FROM (SELECT doc_id, index_name, unnest(list_transform(list_concat([message_id, in_reply_to], coalesce(refs, [])), lambda s: regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '^[<>]+|[<>]+$', '', 'g'))) AS m FROM mail_docs) WHERE m IS NOT NULL AND m <> '')"


@query(f"WITH {_IDS} SELECT index_name, m, doc_id, count(*) OVER (PARTITION BY index_name, m) AS carriers FROM ids")
def thread_members(spark, d):
    return R.thread_members(table(spark, d, "mail_docs"))


@query(f"WITH {_IDS}, one AS (SELECT min(doc_id) AS doc_id FROM mail_docs WHERE in_reply_to <> '') SELECT m.doc_id, m.sent_at FROM mail_docs m, one WHERE m.doc_id <> one.doc_id AND m.doc_id IN (SELECT x.doc_id FROM ids x JOIN ids y ON x.index_name = y.index_name AND x.m = y.m WHERE y.doc_id = one.doc_id) ORDER BY m.sent_at, m.doc_id LIMIT 100")
def thread_order(spark, d):
    m = table(spark, d, "mail_docs")
    one = m.where("in_reply_to <> ''").agg(F.min("doc_id")).first()[0]
    return R.thread_of(m, one or "").select("doc_id", "sent_at")


# lookups and ranking by rules


@query(f"WITH {LIVE} SELECT doc_id, display_path, content_type FROM live WHERE doc_id = (SELECT min(doc_id) FROM index_docs)")
def point_lookup(spark, d):
    one = table(spark, d, "index_docs").agg(F.min("doc_id")).first()[0]
    return rows(spark, d).where(F.col("doc_id") == one).select("doc_id", "display_path", "content_type")


@query(f"WITH {LIVE} SELECT doc_id FROM live WHERE display_path = (SELECT min(display_path) FROM index_docs) ORDER BY doc_id LIMIT 1")
def find_by_path(spark, d):
    one = table(spark, d, "index_docs").agg(F.min("display_path")).first()[0]
    return rows(spark, d).where(F.col("display_path") == one).select("doc_id").orderBy("doc_id").limit(1)


@query(f"WITH {LIVE} SELECT doc_id, display_path FROM live WHERE doc_id IN (SELECT i.doc_id FROM index_docs i JOIN jobs j USING (job_id) WHERE lower(trim(j.status)) <> 'completed')")
def scan_by_ids(spark, d):
    cut = table(spark, d, "jobs").where("lower(trim(status)) <> 'completed'").select("job_id")
    ids = table(spark, d, "index_docs").join(cut, "job_id", "left_semi").select("doc_id").distinct()
    return rows(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "display_path")


@query(f"WITH {LIVE} SELECT doc_id, left(content, 200) AS snippet FROM live WHERE content IS NOT NULL")
def snippet_fallback(spark, d):
    t = rows(spark, d, "content").where("content is not null")
    return t.select("doc_id", X.fragment(F.col("content"), []).alias("snippet"))


_RULE_TERMS = ["insured", "harbour", "report"]


def _rules_sql(terms: list[str]) -> str:
    """The figures of rule_ranks(); the SQL's distance counts bytes, so a letter beyond ASCII is made one."""
    typos = lambda t, w: f"list_min(list_filter(list_transform({t}, lambda x: levenshtein(regexp_replace(x, '[^\\x00-\\x7f]', '?', 'g'), '{w}')), lambda n: n <= {1 if len(w) < 9 else 2}))"
    at = lambda t, w: f"list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = '{w}')"
    apart = lambda t, a, b: f"least(coalesce(list_min(flatten(list_transform({at(t, a)}, lambda i: list_transform({at(t, b)}, lambda j: abs(i - j))))), 8), 8)"
    cols = [f"{typos(t, w)} AS {t}{i}" for i, w in enumerate(terms) for t in "pc"]
    near = " + ".join(f"least({apart('p', a, b)}, {apart('c', a, b)})" for a, b in zip(terms, terms[1:]))
    best = [f"least(p{i}, c{i})" for i in range(len(terms))]
    words, all_typos = " + ".join(f"CAST({b} IS NOT NULL AS INTEGER)" for b in best), " + ".join(f"coalesce({b}, 0)" for b in best)
    place = f"CASE WHEN {' OR '.join(f'p{i} IS NOT NULL' for i in range(len(terms)))} THEN 0 ELSE 1 END"
    exact = f"len(list_filter({terms!r}, lambda w: list_contains(list_concat(p, c), w)))"
    return f"""WITH {LIVE}, t AS (SELECT doc_id, {_PATH} AS p, {_TOK} AS c FROM live), f AS (SELECT *, {', '.join(cols)} FROM t), r AS (SELECT doc_id, {words} AS words, {all_typos} AS typos, {near} AS proximity, {place} AS attribute, {exact} AS exactness FROM f)
 SELECT doc_id, words, typos, proximity, attribute, exactness FROM r WHERE words > 0 ORDER BY words DESC, typos, proximity, attribute, exactness DESC, doc_id LIMIT 100"""


def rule_ranking(spark, d):
    """The 100 best documents for 'insured harbour report' by rules: the path before the content, typos allowed."""
    from docuplane.operators import rules

    t = table(spark, d, "index_docs").select("doc_id", "row_id", "indexed_at", X.path_tokens(F.col("display_path")).alias("p"), X.tokens(F.col("content")).alias("c"))
    figures = rules.rule_ranks(t, _RULE_TERMS, [F.col("p"), F.col("c")])
    names = ["words", "typos", "proximity", "attribute", "exactness"]
    live_rows = I.live(figures.select("doc_id", "row_id", "indexed_at", *names), *names)
    live_rows = live_rows.select("doc_id", *names)
    return live_rows.orderBy(*rules.rule_order()).limit(100)


QUERIES["rule_ranking"] = rule_ranking
SQL["rule_ranking"] = _rules_sql(_RULE_TERMS)


@query(f"WITH {LIVE} SELECT doc_id FROM live WHERE (created_year >= 2015 AND created_year <= 2016) OR created_year IN (2019, 2021)")
def filter_year_any(spark, d):
    return rows(spark, d).where(S.year_any(["from:2015", "to:2016", "2019", "2021", "soon"], F.col("created_year"))).select("doc_id")


@query("WITH x AS (SELECT doc_id, job_id IN (SELECT job_id FROM jobs WHERE lower(trim(status)) = 'completed') AS j FROM index_docs) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM x WHERE NOT coalesce(j, false)) THEN 'updated' ELSE 'created' END AS outcome FROM x WHERE j GROUP BY doc_id")
def put_outcomes(spark, d):
    """What became of each row of completed jobs put over those of all others."""
    t = table(spark, d, "index_docs").select("doc_id", "job_id")
    done = table(spark, d, "jobs").where("lower(trim(status)) = 'completed'").select("job_id")
    return I.outcomes(t.join(done, "job_id", "left_anti"), t.join(done, "job_id", "left_semi"))


@query("SELECT source_path, 'ContentTruncated' AS error_type, display_path || ': ' || length(trim(content, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8239))) || ' characters cut to 1500' AS message FROM index_docs WHERE length(trim(content, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8239))) > 1500")
def content_truncated(spark, d):
    return I.truncated(table(spark, d, "index_docs").select("source_path", "display_path", "content"), 1500)

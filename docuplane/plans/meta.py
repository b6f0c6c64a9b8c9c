"""Queries of projections, scalar functions and row building."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuplane.functions import meta as M, text as X, vectors as V
from docuplane.operators import chunking, index as I
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


_LABELS = ", ".join(f"('{k}','{v}')" for k, v in M.MIME_LABELS.items())
_CLI = ", ".join(f"('{k}','{v}')" for k, v in M.CLI_LABELS.items() if v)


@query("SELECT row_id, trim(split_part(content_type, ';', 1)) AS mime FROM index_docs")
def mime_base_type(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.mime_base(F.col("content_type")).alias("mime"))


@query(f"WITH m(k, v) AS (VALUES {_LABELS}), x AS (SELECT row_id, trim(split_part(content_type, ';', 1)) AS mime FROM index_docs) SELECT x.row_id, coalesce(m.v, x.mime) AS label FROM x LEFT JOIN m ON m.k = x.mime")
def mime_alias(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.label_of(M.mime_base(F.col("content_type"))).alias("label"))


@query(f"WITH m(k, v) AS (VALUES {_CLI}), x AS (SELECT row_id, trim(split_part(content_type, ';', 1)) AS mime FROM index_docs) SELECT x.row_id, coalesce(m.v, x.mime) AS label FROM x LEFT JOIN m ON m.k = x.mime")
def mime_label_cli(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.label_of(M.mime_base(F.col("content_type")), M.CLI_LABELS).alias("label"))


@query(r"SELECT row_id, CASE WHEN length(created) >= 4 AND regexp_full_match(substr(created, 1, 4), '[+-]?[0-9]+') THEN try_cast(substr(created, 1, 4) AS BIGINT) END AS y FROM index_docs")
def created_year(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.year_of(F.col("created")).alias("y"))


@query(r"SELECT row_id, CASE WHEN regexp_full_match(file_size, '[+-]?[0-9]+') THEN try_cast(file_size AS BIGINT) END AS n FROM index_docs")
def file_size_number(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.whole_number(F.col("file_size")).alias("n"))


@query("SELECT row_id, CASE WHEN coalesce(extracted_from, '') = '' THEN 'Parent Document' ELSE 'Attachment' END AS document_type FROM index_docs")
def document_type(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.document_type(F.col("extracted_from")).alias("document_type"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(message_id, '^[\s]+|[\s]+$', '', 'g'), '^[<>]+|[<>]+$', '', 'g') AS m FROM mail_docs")
def norm_message_id(spark, d):
    return table(spark, d, "mail_docs").select("doc_id", M.message_id(F.col("message_id")).alias("m"))


@query(r"SELECT doc_id, i AS place, r FROM (SELECT doc_id, unnest(x) AS r, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(flatten(list_transform(refs, lambda s: regexp_split_to_array(s, '\s+'))), lambda s: regexp_replace(s, '^[<>]+|[<>]+$', '', 'g')), lambda s: s <> '') AS x FROM mail_docs))")
def references_split(spark, d):
    x = table(spark, d, "mail_docs").select("doc_id", F.posexplode(M.references(F.col("refs"))).alias("i", "r"))
    return x.select("doc_id", (F.col("i") + 1).cast("bigint").alias("place"), "r")


_ADDR = r"lower(trim(CASE WHEN regexp_matches({0}, '^[^<]*<[^>]*>') THEN regexp_extract({0}, '^[^<]*<([^>]*)>', 1) ELSE {0} END))"


@query(f"SELECT doc_id, CASE WHEN contains({_ADDR.format('email_from')}, '@') THEN {_ADDR.format('email_from')} END AS address FROM mail_docs")
def extract_email(spark, d):
    return table(spark, d, "mail_docs").select("doc_id", F.lower(M.email_address(F.col("email_from"))).alias("address"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([email_from], coalesce(email_to, [])), lambda s: {_ADDR.format('s')}), lambda s: contains(s, '@')))), ',') AS addresses FROM mail_docs")
def email_address_set(spark, d):
    t = table(spark, d, "mail_docs")
    return t.select("doc_id", F.array_join(F.array_sort(M.address_set(F.array("email_from"), F.col("email_to"))), ",").alias("addresses"))


#: Metadata maps made of the columns of index_docs, where the first key present depends on the row.
def _metadata(t):
    pairs = [("Content-Type", "content_type", F.lit(True)), ("dc:creator", "creator", F.col("row_id") % 3 == 0), ("Author", "creator", F.col("row_id") % 3 == 1), ("creator", "creator", F.lit(True)), ("Creation-Date", "created", F.col("row_id") % 2 == 0), ("date", "modified", F.lit(True)), ("X-TIKA:Parsed-By", "job_id", F.lit(True)), ("pdf:version", "file_size", F.lit(True)), ("Plain", "doc_id", F.lit(True))]
    entries = F.filter(F.array(*[F.when(when & F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.array(F.col(c)).alias("value"))) for k, c, when in pairs]), lambda x: x.isNotNull())
    return t.withColumn("metadata", F.map_from_entries(entries))


@query("SELECT row_id, creator AS m_creator, coalesce(CASE WHEN row_id % 2 = 0 THEN created END, modified) AS m_created FROM index_docs")
def meta_coalesce(spark, d):
    t = _metadata(table(spark, d, "index_docs"))
    m = F.col("metadata")
    return t.select("row_id", M.single(M.first_present(m, M.SOURCE_KEYS["creator"])).alias("m_creator"), M.single(M.first_present(m, M.SOURCE_KEYS["created"])).alias("m_created"))


@query("SELECT row_id, array_to_string(list_sort(list_filter(['Content-Type', CASE WHEN row_id % 3 = 1 AND creator IS NOT NULL THEN 'Author' END, CASE WHEN creator IS NOT NULL THEN 'creator' END, CASE WHEN row_id % 2 = 0 AND created IS NOT NULL THEN 'Creation-Date' END, CASE WHEN modified IS NOT NULL THEN 'date' END, 'Plain'], lambda x: x IS NOT NULL AND (x <> 'Content-Type' OR content_type IS NOT NULL))), ',') AS shown FROM index_docs")
def clean_metadata(spark, d):
    t = _metadata(table(spark, d, "index_docs"))
    return t.select("row_id", F.array_join(F.array_sort(F.map_keys(M.visible(F.col("metadata")))), ",").alias("shown"))


@query("SELECT row_id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT row_id, row_id * row_id * 7 AS n FROM index_docs)")
def human_size(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.human_size(F.col("row_id") * F.col("row_id") * 7).alias("size"))


@query("SELECT row_id, substr(sha256(source_path || ':' || CAST(row_id % 4 AS VARCHAR)), 1, 16) AS h FROM index_docs")
def doc_id_hash(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.file_doc_id(F.col("source_path"), F.col("row_id") % 4).alias("h"))


@query("SELECT row_id, 'store/' || index_name || '/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS dir FROM (SELECT row_id, index_name, substr(sha256(source_path), 1, 16) AS h FROM index_docs)")
def container_dir(spark, d):
    return table(spark, d, "index_docs").select("row_id", F.regexp_replace(M.store_dir(F.col("source_path"), "store", "@"), "@", F.col("index_name")).alias("dir"))


@query("SELECT row_id, CASE WHEN starts_with(source_path, '/srv/intake/' || index_name || '/') THEN substr(source_path, length('/srv/intake/' || index_name) + 2) ELSE list_extract(string_split(source_path, '/'), -1) END AS shown FROM index_docs")
def display_path(spark, d):
    base = F.concat(F.lit("/srv/intake/"), F.col("index_name"))
    return table(spark, d, "index_docs").select("row_id", M.display_path(F.col("source_path"), base).alias("shown"))


@query("SELECT row_id, CASE WHEN contains(display_path, '/') THEN regexp_replace(display_path, '/[^/]*$', '') ELSE '' END AS dir, list_extract(string_split(display_path, '/'), -1) AS file FROM index_docs")
def path_split(spark, d):
    a, b = X.path_split(F.col("display_path"))
    return table(spark, d, "index_docs").select("row_id", a.alias("dir"), b.alias("file"))


@query("SELECT row_id, CASE WHEN p IN ('', '.', '..') OR starts_with(p, '.') THEN NULL ELSE p END AS entry FROM (SELECT row_id, list_extract(string_split(n, '/'), -1) AS p FROM (SELECT row_id, CASE row_id % 4 WHEN 0 THEN display_path || '/..' WHEN 1 THEN display_path || '/.hidden' ELSE display_path END AS n FROM index_docs))")
def safe_entry_name(spark, d):
    p = F.col("display_path")
    n = F.when(F.col("row_id") % 4 == 0, F.concat(p, F.lit("/.."))).when(F.col("row_id") % 4 == 1, F.concat(p, F.lit("/.hidden"))).otherwise(p)
    return table(spark, d, "index_docs").select("row_id", X.safe_entry_name(n).alias("entry"))


@query(rf"SELECT row_id, array_to_string(list_transform(regexp_extract_all(display_path, '{X.PATH_TOKEN}'), lambda x: lower(x)), ' ') AS parts FROM index_docs")
def path_tokens(spark, d):
    return table(spark, d, "index_docs").select("row_id", F.array_join(X.path_tokens(F.col("display_path")), " ").alias("parts"))


@query(r"SELECT w AS term, count(*) AS n, count(DISTINCT row_id) AS rows_with FROM (SELECT row_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM index_docs) GROUP BY w")
def token_counts(spark, d):
    t = table(spark, d, "index_docs").select("row_id", F.explode(X.tokens(F.col("content"))).alias("term"))
    per = t.groupBy("term", "row_id").agg(F.count("*").alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("rows_with"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: {'s': l[i], 'keep': l[i] <> '' OR i = 1 OR l[i - 1] <> ''}), lambda x: x.keep), lambda x: x.s), chr(10)) AS body FROM (SELECT doc_id, list_transform(string_split(replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)), chr(10)), lambda s: CASE WHEN regexp_full_match(s, '[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*') THEN '' ELSE s END) AS l FROM documents WHERE text IS NOT NULL)")
def condense_blank_lines(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", X.condense_blank_lines(F.replace("text", F.lit("\n"), F.lit("\n \n\n"))).alias("body"))


@query(r"SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, '|') AS body FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, d):
    l = X.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(l).cast("bigint").alias("n"), F.array_join(l, "|").alias("body"))


@query(r"SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, '|') AS body FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)")
def paragraph_split(spark, d):
    l = X.paragraphs(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(l).cast("bigint").alias("n"), F.array_join(l, "|").alias("body"))


#: One pass takes the separator with it; so two, between which what is marked stands between letters that no text has.
_MARKED = r"regexp_replace({0}, '(?i)(^|[^\p{{L}}\p{{N}}])(provisional|harbour|permit)($|[^\p{{L}}\p{{N}}])', '\1ꓸ\2ꓹ\3', 'g')"


@query(f"SELECT doc_id, replace(replace({_MARKED.format(_MARKED.format('text'))}, 'ꓸ', '<mark>'), 'ꓹ', '</mark>') AS body FROM documents WHERE text IS NOT NULL")
def highlight_terms(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", X.highlight(F.col("text"), ["provisional", "harbour", "permit"]).alias("body"))


@query("SELECT doc_id, replace(replace('<mark>' || text || '</mark>', '<mark>', ''), '</mark>', '') AS body FROM documents WHERE text IS NOT NULL")
def strip_highlights(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.strip_highlights(F.concat(F.lit(X.MARK), "text", F.lit(X.UNMARK))).alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS short FROM documents WHERE text IS NOT NULL")
def truncate_ellipsis(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents WHERE text IS NOT NULL")
def html_escape(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.html_escape(F.col("text")).alias("html"))


@query(r"SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', 'and'), '<', '('), '>', ')'), '[ \t\n\v\f\r]+', ' ', 'g') AS body FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM documents WHERE text IS NOT NULL)")
def html_to_text(spark, d):
    plain = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("and")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    html = F.concat(F.lit("<html><head><style>p {x}</style></head><body><p class='a'>"), F.replace(plain, F.lit("\n"), F.lit("\n<br/>\n")), F.lit("</p><script>var x</script></body></html>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.html_to_text(html).alias("body"))


@query()
def chunk_text(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    x = t.select("doc_id", F.posexplode(chunking.chunks(F.col("text"), 600, 80)).alias("chunk_no", "chunk"))
    return x.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.octet_length("chunk").cast("bigint").alias("bytes"))


def embed_documents(spark, d):
    """The vectors of all texts, with 4 decimals as one string."""
    e = V.HashingEmbedder(16).column()
    shown = F.array_join(F.transform(e("text"), lambda x: F.format_number(x, 4)), " ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", shown.alias("vector"))


QUERIES["embed_documents"] = embed_documents


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {_NORM})), 6) AS total, round({_NORM} / {_NORM}, 6) AS length FROM embeddings")
def l2_normalize(spark, d):
    t = table(spark, d, "embeddings").withColumn("u", V.l2_normalize(F.col("embedding")))
    return t.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.norm(F.col("u")), 6).alias("length"))


@query("SELECT row_id, least(pow(2.0, least(row_id % 40, 31)), 30.0) AS seconds FROM index_docs")
def retry_backoff(spark, d):
    return table(spark, d, "index_docs").select("row_id", M.backoff_seconds(F.col("row_id") % 40).alias("seconds"))


_SIZE = "(CASE WHEN {0} IS NULL THEN 4 ELSE strlen({0}) + strlen({0}) // 10 + 2 END)"


@query(f"SELECT row_id, CAST(2 + 10 + {_SIZE.format('doc_id')} + 16 + {_SIZE.format('display_path')} + 11 + {_SIZE.format('content')} + 18 + (CASE WHEN has_embeddings IS NULL THEN 4 ELSE 5 END) + 16 + (CASE WHEN created_year IS NULL THEN 4 ELSE 20 END) AS BIGINT) AS bytes FROM index_docs")
def doc_size_estimate(spark, d):
    cols = {"doc_id": "string", "display_path": "string", "content": "string", "has_embeddings": "boolean", "created_year": "number"}
    return table(spark, d, "index_docs").select("row_id", I.size_estimate({k: (v, F.col(k)) for k, v in cols.items()}).alias("bytes"))


@query(f"SELECT row_id, length(CASE WHEN n > 1500 THEN left(content, CAST(floor(length(content) * 1500 * 9 / (n * 10)) AS BIGINT)) ELSE content END) AS kept FROM (SELECT row_id, content, CAST(2 + 11 + {_SIZE.format('content')} AS DOUBLE) AS n FROM index_docs WHERE content IS NOT NULL)")
def oversize_truncation(spark, d):
    t = table(spark, d, "index_docs").where("content is not null")
    return t.select("row_id", F.length(I.fit_size(F.col("content"), I.size_estimate({"content": ("string", F.col("content"))}), 1500)).cast("bigint").alias("kept"))


@query(f"WITH RECURSIVE s AS (SELECT index_name, row_id, CAST(2 + 11 + {_SIZE.format('content')} AS BIGINT) + 1 AS need, row_number() OVER (PARTITION BY index_name ORDER BY row_id) AS i FROM index_docs), w AS (SELECT index_name, row_id, i, need + 2 AS used, CAST(0 AS BIGINT) AS batch FROM s WHERE i = 1 UNION ALL SELECT s.index_name, s.row_id, s.i, CASE WHEN w.used + s.need > 65536 THEN s.need + 2 ELSE w.used + s.need END, w.batch + CASE WHEN w.used + s.need > 65536 THEN 1 ELSE 0 END FROM w JOIN s ON s.index_name = w.index_name AND s.i = w.i + 1) SELECT index_name, row_id, batch FROM w")
def payload_batches(spark, d):
    t = table(spark, d, "index_docs").select("index_name", "row_id", I.size_estimate({"content": ("string", F.col("content"))}).alias("bytes"))
    return chunking.payload_batches(t, "index_name", "row_id", "bytes", 65_536, per_row=1, per_batch=2)


@query(r"SELECT DISTINCT p FROM (SELECT array_to_string(l[1:unnest(range(1, len(l)))], '/') AS p FROM (SELECT string_split(display_path, '/') AS l FROM index_docs) WHERE len(l) > 1)")
def container_prefixes(spark, d):
    parts = F.split("display_path", "/")
    x = table(spark, d, "index_docs").select(parts.alias("l")).where(F.size("l") > 1).distinct()
    return x.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda n: F.array_join(F.slice("l", 1, n), "/"))).alias("p")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT c_custkey, length(p) >= 8 AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[^A-Za-z0-9]') AS ok FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) WHEN 2 THEN 'Ab1' || c_mktsegment WHEN 3 THEN 'a#' || c_name ELSE 'abcdefgh' END AS p FROM customer)")
def password_policy(spark, d):
    from docuplane.operators.jobs import password_ok

    k = F.col("c_custkey") % 5
    p = F.when(k == 0, F.col("c_name")).when(k == 1, F.lower("c_name")).when(k == 2, F.concat(F.lit("Ab1"), "c_mktsegment")).when(k == 3, F.concat(F.lit("a#"), "c_name")).otherwise("abcdefgh")
    return table(spark, d, "customer").select("c_custkey", password_ok(p).alias("ok"))


@query("SELECT row_id, coalesce(creator, '') AS creator, CASE WHEN row_id % 2 = 0 THEN 'curated' ELSE coalesce(modified, '') END AS date, CASE WHEN content_type IS NULL THEN '' ELSE content_type END AS type FROM index_docs")
def meta_overlay(spark, d):
    t = _metadata(table(spark, d, "index_docs"))
    curated = F.when(F.col("row_id") % 2 == 0, F.create_map(F.lit("date"), F.array(F.lit("curated")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    m = M.overlay(F.col("metadata"), curated)
    one = lambda k: F.coalesce(M.single(F.try_element_at(m, F.lit(k))), F.lit(""))
    return t.select("row_id", one("creator").alias("creator"), one("date").alias("date"), one("Content-Type").alias("type"))


@query(r"SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(harbour|perm)', '<mark>\1</mark>', 'g') AS body FROM documents WHERE text IS NOT NULL")
def highlight_client(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.highlight_parts(F.col("text"), "perm harbour").alias("body"))

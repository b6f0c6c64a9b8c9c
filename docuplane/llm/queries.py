"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from docuplane.llm import leaks, mails, names, neardup, pieces, residue, scans, tokens
from docuplane.session import table


def p2_found(spark, d):
    return names.entity_pairs(table(spark, d, "creator_values")).toDF("value_id_a", "value_id_b")


def p3_found(spark, d):
    pairs = neardup.near_duplicate_pairs(neardup.file_text(table(spark, d, "index_docs")))
    return pairs.toDF("doc_id_a", "doc_id_b")


def p5_found(spark, d):
    return scans.repairs(table(spark, d, "scan_pages"), table(spark, d, "jobs"))


def p6_found(spark, d):
    return pieces.oversized_pieces(table(spark, d, "index_docs"), table(spark, d, "index_embeddings"))


def p6_landmarks(spark, d):
    """The contents of p6_found in content-defined pieces."""
    return pieces.content_defined_pieces(table(spark, d, "index_docs"), table(spark, d, "index_embeddings"))


def p7_found(spark, d):
    return mails.newly_written(table(spark, d, "mail_docs"))


def p8_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_found(spark, d):
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return residue.residue(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_landmarks": p6_landmarks, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
SQL: dict[str, str] = {
    "p3_found": r"""WITH t AS (SELECT DISTINCT doc_id, lower(list_extract(string_split(replace(coalesce(display_path, ''), '\', '/'), '/'), -1) || ' ' || coalesce(content, '')) AS s FROM index_docs),
 w AS (SELECT doc_id, regexp_extract_all(s, '[a-z0-9]+') AS w FROM t),
 every_run AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w WHERE len(w) > 2),
 n AS (SELECT doc_id, count(*) AS n FROM every_run GROUP BY doc_id HAVING count(*) >= 20),
 r AS (SELECT * FROM every_run SEMI JOIN n USING (doc_id)),
 p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS c FROM r a JOIN r b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
 SELECT doc_id_a, doc_id_b FROM p JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b WHERE 10 * c >= 6 * (x.n + y.n - c)""",
    "p6_found": r"""WITH RECURSIVE lim AS (SELECT index_name, CAST(4 * arg_max(context_length, (updated_at, context_length)) AS BIGINT) AS l FROM index_embeddings WHERE context_length > 0 GROUP BY index_name),
 d AS (SELECT doc_id, arg_min(content, row_id) AS c, arg_min(l, row_id) AS l FROM index_docs JOIN lim USING (index_name) WHERE length(content) > l GROUP BY doc_id),
 w AS (SELECT doc_id, CAST(0 AS BIGINT) AS no, CAST(NULL AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS nxt FROM d
  UNION ALL SELECT doc_id, no + 1, s, e, CASE WHEN e = n THEN n WHEN m > 0 THEN e - l // 10 - 1 + m ELSE e - l // 10 END
  FROM (SELECT *, length(regexp_extract(substr(c, e - l // 10, l // 10), '(?s)^([^ \n]*[ \n])', 1)) AS m
   FROM (SELECT doc_id, no, s, l, n, c, CASE WHEN n - s <= l THEN n WHEN a > 0 THEN low - 1 + a WHEN b > 0 THEN low - 1 + b WHEN k > 0 THEN low + k ELSE s + l END AS e
    FROM (SELECT *, length(regexp_extract(t, '(?s)^(.*\n\n)', 1)) AS a, length(regexp_extract(t, '(?s)^(.*[.!?][ \n])', 1)) AS b, length(regexp_extract(substr(t, 2), '(?s)^(.*[ \n])', 1)) AS k
     FROM (SELECT w.doc_id, w.no, w.nxt AS s, d.l, d.c, length(d.c) AS n, w.nxt + d.l // 2 AS low, substr(d.c, w.nxt + d.l // 2, d.l - d.l // 2 + 1) AS t FROM w JOIN d USING (doc_id) WHERE w.nxt < length(d.c))))))
 SELECT doc_id, no AS piece_no, s AS piece_start, e AS piece_end FROM w WHERE no > 0""",
}

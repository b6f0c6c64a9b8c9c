"""Queries over whole tables, whatever their texts hold: against brute force on fixtures, and with all rows of their SQL.

The SQL of some queries leaves rows out; there the query has more rows, and test_oracle says so until the SQL is changed.
"""

import os
import re
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docuplane.plans import jobs, meta, search
from tests.oracle import connect, plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXTS = [
    "plain", "", "Größe und Öl " * 30, "“quoted” " * 40, "é" * 150, "\U0001f69a" * 201, "a\x01b\x07" * 80, "x" * 79 + "é", "x" * 80 + "é", "\U0001f69a" * 80, "\U0001f69a" * 81, "é" * 45,
    "a\n \n \t\nb", "a\n　\n  \nb \n", "ä\n​\n\nb", "é\r\n\r\n\u0085\nb", " \n \n \nz", "a\x0b\n\x0c\n\x01\n\x1c\n\nb", "\n", "\n\n \nb", "a\n ", "a\n\n\n",
    "Harbour permit, PROVISIONAL harbour—permit permits", "permit permit permit", "üpermit éharbouré (harbour)/provisional\nharbour",
]
#: White space as Unicode has it (Python's isspace has \x1c to \x1f besides).
BLANKS = {chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}


def write(folder, name, **columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def has_all_of_its_sql(query, sql, spark):
    got = {tuple(plain(r[c]) for c in sorted(r.asDict())) for r in query(spark, SF).collect()}
    rel = connect(SF).sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return {tuple(plain(r[i]) for i in order) for r in rel.fetchall()} <= got


def test_snippets_of_every_text(spark, tmp_path):
    old, new = [t + " old" for t in TEXTS], [*TEXTS, None]
    content, n = old + new, len(old) + len(new)
    ids = [f"d{i}" for i in [*range(len(old)), *range(len(new))]]
    none = pa.array([None] * n, pa.string())
    write(
        tmp_path, "index_docs", doc_id=ids, row_id=list(range(n)), indexed_at=[0] * len(old) + [1] * len(new), content=pa.array(content, pa.string()), has_embeddings=[False] * n,
        **{c: none for c in ("index_name", "content_type", "creator", "created", "file_size", "extracted_from", "display_path")},
    )
    got = {r.doc_id: r.snippet for r in search.snippet_fallback(spark, str(tmp_path)).collect()}
    assert got == {f"d{i}": t[:200] for i, t in enumerate(TEXTS)}


def test_snippets_with_all_of_the_sql(spark):
    assert has_all_of_its_sql(search.snippet_fallback, search.SQL["snippet_fallback"], spark)


def condensed(text):
    out = []
    for line in text.replace("\n", "\n \n\n").split("\n"):
        line = "" if line and set(line) <= BLANKS else line
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out)


def truncated(text):
    return text if len(text) <= 80 else text[:79] + "…"


def highlighted(text):
    parts = [""]
    for c in text:  # runs of letters and digits at odd places
        if (unicodedata.category(c)[0] in "LN") == len(parts) % 2:
            parts.append("")
        parts[-1] += c
    return "".join(f"<mark>{p}</mark>" if re.fullmatch("(?ai)provisional|harbour|permit", p) else p for p in parts)


@pytest.mark.parametrize("query, expected", [(meta.condense_blank_lines, condensed), (meta.truncate_ellipsis, truncated), (meta.highlight_terms, highlighted)])
def test_every_text(spark, tmp_path, query, expected):
    write(tmp_path, "documents", doc_id=list(range(len(TEXTS) + 1)), text=pa.array([*TEXTS, None], pa.string()))
    assert {r[0]: r[1] for r in query(spark, str(tmp_path)).collect()} == {i: expected(t) for i, t in enumerate(TEXTS)}
    have = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    assert {r[0]: r[1] for r in query(spark, SF).collect()} == {i: expected(t) for i, t in have.items()}


@pytest.mark.parametrize("name", ["condense_blank_lines", "truncate_ellipsis", "highlight_terms"])
def test_texts_with_all_of_the_sql(spark, name):
    assert has_all_of_its_sql(meta.QUERIES[name], meta.SQL[name], spark)


def test_every_user(spark, tmp_path):
    write(tmp_path, "customer", c_custkey=list(range(1, 1201)))
    write(tmp_path, "index_profiles", index_name=["b", "a", "c"])
    own = {(i, f"user{k}") for k in range(1, 1201) for n, i in enumerate("abc", 1) if (k + n) % 7 == 0} | {("*", f"user{k}") for k in range(50, 1201, 50)}
    got = [(r.index_name, r.user_name) for r in jobs.join_index_users(spark, str(tmp_path)).collect()]
    assert len(got) == len(own) and set(got) == own
    assert {r.user_name for r in jobs.permissions(spark, str(tmp_path)).collect()} == {u for _, u in own}


@pytest.mark.parametrize("name", ["join_index_users", "visible_indices", "visible_indices_all"])
def test_users_with_all_of_the_sql(spark, name):
    assert has_all_of_its_sql(jobs.QUERIES[name], jobs.SQL[name], spark)

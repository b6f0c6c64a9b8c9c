"""Queries of the general corpus operators."""

from __future__ import annotations

from docuplane.operators import hierarchy, timestamps
from docuplane.session import table


def p1_found(spark, d):
    return timestamps.date_repairs(table(spark, d, "index_docs"), table(spark, d, "index_profiles"))


def p1_zones(spark, d):
    """The zone of each index as its rows alone tell it, without home_zone: index_name, home_zone, violations, tests."""
    p = table(spark, d, "index_profiles")
    docs = table(spark, d, "index_docs").select("index_name", "created", "modified", "indexed_at").join(p.select("index_name", "date_order"), "index_name", "left")
    known = timestamps.offset_histories(spark, p.select(p.home_zone.alias("zone")))
    return timestamps.estimate_zones(docs, known, "date_order")


def p4_found(spark, d):
    return hierarchy.forest(table(spark, d, "index_docs"), table(spark, d, "mail_docs"))


def p4_descendants(spark, d):
    return hierarchy.forest_descendants(table(spark, d, "index_docs"), table(spark, d, "mail_docs"))


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p4_found": p4_found, "p4_descendants": p4_descendants}
_PATH = "array_to_string(list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/')"
_ID = r"nullif(regexp_replace({0}, '^[\s<>]+|[\s<>]+$', '', 'g'), '')"

_LINKS = f"""d AS (SELECT DISTINCT index_name, doc_id, {_PATH.format("display_path")} AS p, {_PATH.format("extracted_from")} AS x FROM index_docs),
 places AS (SELECT index_name, p, min(doc_id) AS parent FROM d WHERE p <> '' GROUP BY ALL),
 m AS (SELECT {_ID.format("message_id")} AS node, {_ID.format("in_reply_to")} AS r, list_transform(refs, lambda s: {_ID.format("s")}) AS f FROM mail_docs WHERE {_ID.format("message_id")} IS NOT NULL),
 named AS (SELECT node, r AS up, 0 AS place FROM m UNION ALL SELECT node, unnest(f), unnest(range(len(f), 0, -1)) FROM m WHERE len(f) > 0),
 e AS (SELECT 'container' AS kind, doc_id AS node, min(parent) AS parent FROM d JOIN places ON places.index_name = d.index_name AND places.p = d.x WHERE d.x <> '' GROUP BY ALL
  UNION ALL SELECT 'thread', node, arg_min(up, (place, up)) FROM named WHERE up IN (SELECT node FROM m) GROUP BY ALL),
 c AS (SELECT kind, node, parent AS up, 1 AS depth, [node] AS way FROM e
  UNION ALL SELECT c.kind, c.node, e.parent, c.depth + 1, list_append(c.way, c.up) FROM c JOIN e ON e.kind = c.kind AND e.node = c.up WHERE NOT list_contains(c.way, c.up))"""

#: Without `..` in paths, which the tables don't have.
SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE {_LINKS},
 last AS (SELECT kind, node, arg_max(up, depth) AS up, max(depth) AS depth, arg_max(way, depth) AS way FROM c GROUP BY ALL),
 found AS (SELECT kind, node, CASE WHEN list_contains(way, up) THEN list_min(way[list_position(way, up):]) ELSE up END AS root, CASE WHEN list_contains(way, up) THEN -1 ELSE depth END AS depth FROM last),
 below AS (SELECT kind, up AS node, count(DISTINCT node) AS n FROM c GROUP BY ALL)
 SELECT f.kind AS tree_kind, f.node AS node_key, f.root AS root_key, CAST(f.depth AS BIGINT) AS node_depth, CAST(CASE WHEN f.depth = -1 THEN -1 ELSE coalesce(b.n, 0) END AS BIGINT) AS n_below FROM found f LEFT JOIN below b USING (kind, node)
 UNION ALL SELECT b.kind, b.node, b.node, 0, b.n FROM below b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = b.kind AND e.node = b.node)""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS},
 looped AS (SELECT DISTINCT kind, node FROM c WHERE list_contains(way, up))
 SELECT kind AS tree_kind, up AS ancestor_key, node AS node_key, CAST(depth AS BIGINT) AS distance FROM c WHERE (kind, node) NOT IN (SELECT (kind, node) FROM looped)""",
}

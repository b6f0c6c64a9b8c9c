"""Parent-child links turned into full trees by leaf peeling.

Peeling from the leaves up carries subtree sizes to the parents, one level a round, and the levels are walked back from the roots,
which hand path, depth and root down. A level of few leaves isn't worth a round: once less than a third of the nodes that are
still there are leaves, chains (and loops) are left, and these are contracted by doubling: every node takes over the ancestor of its
ancestor, which carries sums up and distances down over twice the way each round. What then still has an ancestor is on a loop or
below one. So the rounds are logarithmic in the number of nodes, whatever the shape, and none is left out. Each round writes one
table into the shared folder and so needs no long lineage. No group is ever collected: a parent with very many children only
receives partial sums, and descendants are rows, not lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from docuplane.session import Scratch


def path_key(p) -> F.Column:
    """A path as compared: back slashes turned, empty and `.` segments dropped, `..` resolved, no outer slashes. Null stays null."""
    parts = F.filter(F.split(F.regexp_replace(p, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.when(p.contains(".."), F.array_join(up, "/")).otherwise(F.array_join(parts, "/"))


def message_key(m) -> F.Column:
    """A message id as compared: without outer blanks and angle brackets; null for null and empty."""
    return F.nullif(F.regexp_replace(m, r"(?U)^[\s<>]+|[\s<>]+$", ""), F.lit(""))


def container_links(docs: DataFrame) -> DataFrame:
    """node, parent: doc_id and the doc_id of the same index whose display_path is the path in extracted_from.

    Repeated rows count once; of several documents with one path the smallest doc_id is the parent; of several parents of one
    document the smallest. Null or empty extracted_from, and paths of no document, give no link.
    """
    rows = docs.select("index_name", "doc_id", path_key(F.col("display_path")).alias("p"), path_key(F.col("extracted_from")).alias("e")).where("doc_id is not null")
    at = rows.where("p <> ''").groupBy("index_name", "p").agg(F.min("doc_id").alias("parent"))
    kids = rows.where("e <> ''").select("index_name", "doc_id", "e").distinct()
    return kids.join(at.withColumnRenamed("p", "e"), ["index_name", "e"]).groupBy(F.col("doc_id").alias("node")).agg(F.min("parent").alias("parent"))


def thread_links(mails: DataFrame) -> DataFrame:
    """node, parent: message ids; the parent is the in_reply_to message if it's here, else the last of refs that is.

    A message stored more than once is one node; if its rows name different parents, in_reply_to goes before refs and then the
    smaller id. Rows without message id are no nodes.
    """
    rows = mails.select(message_key(F.col("message_id")).alias("node"), message_key(F.col("in_reply_to")).alias("r"), F.transform("refs", message_key).alias("f")).where("node is not null")
    ids = rows.select(F.col("node").alias("to")).distinct()
    # place 0 is in_reply_to, then refs from the last to the first
    named = F.concat(F.array("r"), F.reverse(F.coalesce("f", F.array().cast("array<string>"))))
    links = rows.select("node", F.posexplode(named).alias("place", "to")).where("to is not null").groupBy("node", "to").agg(F.min("place").alias("place"))
    return links.join(ids, "to", "left_semi").groupBy("node").agg(F.min(F.struct("place", "to")).alias("x")).select("node", F.col("x.to").alias("parent"))


_DONE = "node string, parent string, root string, depth bigint, n_below bigint, path array<string>"
#: Peeling goes on while at least one node in so many is a leaf.
WORTH = 3


def _written(scratch: Scratch, df: DataFrame, **counts: Column) -> tuple[DataFrame, str, list[int]]:
    """df written and read back, its path, its rows and the counts over it."""
    seen = Observation()
    path = scratch.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]))
    return scratch.read(path, schema=df.schema), path, [seen.get["rows"], *[seen.get[k] for k in counts]]


def _contracted(scratch: Scratch, rest: DataFrame, paths: bool) -> DataFrame:
    """_DONE of what peeling left (node, parent, below), by pointer doubling.

    far: the ancestor 2 ** k above, null where the root is nearer; dist, low: the distance to it or to the root, and the smallest key,
    of the way up to there; top: the root, if reached; total: the size of the subtree within the distance.
    """
    is_root = F.col("parent").isNull()
    t, path, (n, far) = _written(scratch, rest.select(
        "node", "parent", F.col("parent").alias("far"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("dist"), F.col("node").alias("low"), F.when(is_root, F.col("node")).alias("top"), (F.col("below") + 1).alias("total"),
    ), far=F.col("far").isNotNull())
    reach, before = 1, -1
    while far and (far != before or reach < far):
        up = t.select(F.col("node").alias("far"), F.col("far").alias("far2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"), F.col("top").alias("top2"))
        sent = t.where("far is not null").groupBy(F.col("far").alias("node")).agg(F.sum("total").alias("more"))
        step = t.join(up, "far", "left").join(sent, "node", "left").select(
            "node", "parent", F.col("far2").alias("far"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.least("low", "low2").alias("low"), F.coalesce("top", "top2").alias("top"),
            (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"),
        )
        old, before, reach = path, far, 2 * reach
        t, path, (_, far) = _written(scratch, step, far=F.col("far").isNotNull())
        scratch.drop(old)
    tree = t.where("top is not null").select("node", "parent", F.col("top").alias("root"), F.col("dist").alias("depth"), (F.col("total") - 1).alias("n_below"))
    tree = _with_ways(scratch, tree) if paths else tree.withColumn("path", F.lit(None).cast("array<string>"))
    # the ancestor at least as far away as there are nodes left is on the loop, and the way from there goes all around
    loops = t.where("top is null").join(t.select(F.col("node").alias("far"), F.col("low").alias("root")), "far")
    none = F.lit(-1).cast("bigint")
    return tree.unionByName(loops.select("node", "parent", "root", none.alias("depth"), none.alias("n_below"), F.lit(None).cast("array<string>").alias("path")))


def _with_ways(scratch: Scratch, tree: DataFrame) -> DataFrame:
    """tree with path, by doubling."""
    t, path, (_, far) = _written(scratch, tree.withColumn("far", F.col("parent")).withColumn("path", F.array("node")), far=F.col("far").isNotNull())
    while far:
        up = t.select(F.col("node").alias("far"), F.col("far").alias("far2"), F.col("path").alias("way"))
        step = t.join(up, "far", "left").withColumn("path", F.concat(F.coalesce("way", F.array().cast("array<string>")), "path"))
        old = path
        t, path, (_, far) = _written(scratch, step.select(*tree.columns, F.col("far2").alias("far"), "path"), far=F.col("far").isNotNull())
        scratch.drop(old)
    return t.drop("far")


def hierarchy(links: DataFrame, paths: bool = True, worth: int = WORTH) -> DataFrame:
    """Trees of all links (node, parent; one parent per node, others are refused by taking the smallest).

    Returns node, parent (null for a root), root, depth (root 0), n_below, path (keys from the root to the node, null where not asked
    for by `paths`: the paths of a chain are as many as the square of its length) for every node with a parent or child. On a loop or
    below one: root = the smallest key on the loop, depth = n_below = -1, path null. A node that names itself is a loop of one. Empty
    links give an empty table. `worth` only says how soon contraction takes over from peeling, the rows don't depend on it.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    kids = scratch.cut(links.where("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent")))
    fan = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("pending"))
    state = fan.join(kids, "node", "full").select("node", "parent", F.coalesce("pending", F.lit(0)).cast("bigint").alias("pending"), F.lit(0).cast("bigint").alias("below"))
    leaf = F.col("pending") == 0
    now, path, (n, leaves) = _written(scratch, state, leaves=leaf)
    levels = []
    while leaves and leaves * worth >= n:
        levels.append((now, path))
        if n == leaves:
            n = 0
            break
        sent = now.where(leaf & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.sum(F.col("below") + 1).alias("s"))
        rest = now.where(~leaf).join(sent, "node", "left")
        now, path, (n, leaves) = _written(scratch, rest.select("node", "parent", (F.col("pending") - F.coalesce("c", F.lit(0))).alias("pending"), (F.col("below") + F.coalesce("s", F.lit(0))).alias("below")), leaves=leaf)

    out = [scratch.write(_contracted(scratch, now, paths).select(*[c.split()[0] for c in _DONE.split(", ")]))] if n else []
    for level, at in reversed(levels):
        level = level.where(leaf).select("node", "parent", "below")
        if out:
            above = scratch.read(*out, schema=_DONE).select(F.col("node").alias("parent"), F.col("root").alias("r"), F.col("depth").alias("d"), *[F.col("path").alias("way")] * paths)
            level = level.join(above, "parent", "left")
        else:
            level = level.selectExpr("*", "cast(null as string) r", "cast(null as bigint) d", "cast(null as array<string>) way")
        is_root, bad = F.col("parent").isNull(), F.col("d") == -1
        way = F.when(is_root, F.array("node")).when(~bad, F.concat("way", F.array("node"))) if paths else F.lit(None).cast("array<string>")
        out.append(scratch.write(level.select(
            "node", "parent", F.when(is_root, F.col("node")).otherwise(F.col("r")).alias("root"),
            F.when(is_root, 0).when(bad, -1).otherwise(F.col("d") + 1).cast("bigint").alias("depth"),
            F.when(bad, -1).otherwise(F.col("below")).cast("bigint").alias("n_below"),
            way.alias("path"),
        )))
        scratch.drop(at)
    if not out:
        return links.sparkSession.createDataFrame([], _DONE)
    return scratch.read(*out, schema=_DONE)


def descendants(trees: DataFrame) -> DataFrame:
    """All descendants of each node of hierarchy(): ancestor, descendant, distance. Nodes on or below loops have none."""
    return (
        trees.select(F.col("node").alias("descendant"), F.posexplode("path").alias("i", "ancestor"), F.col("depth"))
        .where("ancestor <> descendant")
        .select("ancestor", "descendant", (F.col("depth") - F.col("i")).cast("bigint").alias("distance"))
    )


def _both(index_docs: DataFrame, mail_docs: DataFrame, paths: bool) -> DataFrame:
    """Trees of the files (keys with c: before) and of the mails (t:)."""

    def tagged(links: DataFrame, tag: str) -> DataFrame:
        return links.select(F.concat(F.lit(tag), "node").alias("node"), F.concat(F.lit(tag), "parent").alias("parent"))

    return hierarchy(tagged(container_links(index_docs), "c:").unionByName(tagged(thread_links(mail_docs), "t:")), paths)


def forest(index_docs: DataFrame, mail_docs: DataFrame) -> DataFrame:
    """Container trees of the files and threads of the mails in one run: tree_kind, node_key, root_key, node_depth, n_below."""
    trees = _both(index_docs, mail_docs, paths=False)
    kind = F.when(F.col("node").startswith("c:"), "container").otherwise("thread")
    return trees.select(kind.alias("tree_kind"), F.substring("node", 3, 1 << 30).alias("node_key"), F.substring("root", 3, 1 << 30).alias("root_key"), F.col("depth").alias("node_depth"), "n_below")


def forest_descendants(index_docs: DataFrame, mail_docs: DataFrame) -> DataFrame:
    """tree_kind, ancestor_key, node_key, distance: every node with each of its ancestors, over the trees of forest()."""
    pairs = descendants(_both(index_docs, mail_docs, paths=True))
    kind = F.when(F.col("ancestor").startswith("c:"), "container").otherwise("thread")
    return pairs.select(kind.alias("tree_kind"), F.substring("ancestor", 3, 1 << 30).alias("ancestor_key"), F.substring("descendant", 3, 1 << 30).alias("node_key"), "distance")

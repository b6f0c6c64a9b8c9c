"""Trees against plain recursion."""

import random

from docuplane.operators import hierarchy as H


def brute(links):
    parent = {}
    for a, b in links:
        if a is not None and b is not None:
            parent[a] = min(b, parent.get(a, b))
    nodes = set(parent) | set(parent.values())
    kids = {n: [k for k, p in parent.items() if p == n] for n in nodes}
    out = {}
    for n in nodes:
        way, x = [], n
        while x not in way:
            way.append(x)
            if x not in parent:
                break
            x = parent[x]
        if x in parent:
            loop = way[way.index(x):]
            out[n] = (min(loop), -1, -1)
        else:
            below, todo = 0, list(kids[n])
            while todo:
                k = todo.pop()
                below += 1
                todo += kids[k]
            out[n] = (x, len(way) - 1, below)
    return out


def got(spark, links):
    df = spark.createDataFrame(links, "node string, parent string")
    t = H.hierarchy(df)
    rows = t.collect()
    for r in rows:
        assert (r.path is None) == (r.depth == -1) and (r.path is None or (r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1))
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: (r.root, r.depth, r.n_below) for r in rows}


def test_random_forests_with_loops(spark):
    random.seed(4)
    for n in (3, 40):
        links = [(f"n{i:02d}", f"n{random.randrange(n):02d}") for i in range(n) if random.random() < 0.8]
        assert got(spark, links) == brute(links)


def test_shapes(spark):
    chain = [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 12)]
    star = [(f"s{i:03d}", "hub") for i in range(300)]
    loop = [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("self", "self"), ("kid", "self")]
    links = chain + star + loop + [("a", None), (None, "b"), (None, None), ("two", "p2"), ("two", "p1"), ("two", "p1")]
    assert got(spark, links) == brute(links)


def test_empty(spark):
    assert got(spark, []) == {} and got(spark, [("a", None)]) == {}


def test_descendants(spark):
    t = H.hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("l", "l")], "node string, parent string"))
    pairs = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(t).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_links(spark):
    docs = spark.createDataFrame(
        [("i", "1", "a/b.zip", None, 0), ("i", "2", "a/b.zip/x.txt", "./a//b.zip/", 0), ("i", "2", "a/b.zip/x.txt", "./a//b.zip/", 1), ("i", "3", "a/b.zip/y", "a\\b.zip", 0), ("j", "4", "q", "a/b.zip", 0), ("i", "5", "z", "", 0), ("i", "6", "w", "a/c/../b.zip", 0), (None, None, None, None, None)],
        "index_name string, doc_id string, display_path string, extracted_from string, node int",
    )
    assert {tuple(r) for r in H.container_links(docs).collect()} == {("2", "1"), ("3", "1"), ("6", "1")}
    mails = spark.createDataFrame(
        [("d1", " <m1> ", None, None), ("d2", "m2", "<m1>", ["gone"]), ("d3", "m3", "lost", ["m1", "<m2>", "gone"]), ("d4", None, "m1", None), ("d5", "m2", "<m1>", []), ("d6", "m6", "", [None, "m2"]), ("d7", "", None, None)],
        "doc_id string, message_id string, in_reply_to string, refs array<string>",
    )
    assert {tuple(r) for r in H.thread_links(mails).collect()} == {("m2", "m1"), ("m3", "m2"), ("m6", "m2")}
    forest = {(r.tree_kind, r.node_key): (r.root_key, r.node_depth, r.n_below) for r in H.forest(docs, mails).collect()}
    assert forest[("container", "1")] == ("1", 0, 3) and forest[("thread", "m3")] == ("m1", 2, 0)


def test_long_chain_and_loops_by_contraction(spark):
    chain = [(f"c{i:05d}", f"c{i - 1:05d}") for i in range(1, 20_001)]
    loops = [(f"l{i:03d}", f"l{(i + 1) % 300:03d}") for i in range(300)] + [(f"b{i:03d}", f"b{i + 1:03d}" if i < 99 else "l007") for i in range(100)]
    t = {r.node: r for r in H.hierarchy(spark.createDataFrame(chain + loops, "node string, parent string"), paths=False).collect()}
    assert len(t) == 20_001 + 400
    assert all((t[f"c{i:05d}"].root, t[f"c{i:05d}"].depth, t[f"c{i:05d}"].n_below) == ("c00000", i, 20_000 - i) for i in range(20_001))
    assert all((r.root, r.depth, r.n_below) == ("l000", -1, -1) for k, r in t.items() if k[0] in "lb")


def test_rows_do_not_depend_on_when_contraction_begins(spark):
    random.seed(5)
    links = [(f"n{i:02d}", f"n{max(0, i - random.choice((1, 1, 1, 7))):02d}") for i in range(1, 60)] + [("x", "y"), ("y", "x"), ("z", "x"), ("zz", "z")]
    df = spark.createDataFrame(links, "node string, parent string")
    for worth in (0, 2, 1000):
        rows = H.hierarchy(df, worth=worth).collect()
        assert {r.node: (r.root, r.depth, r.n_below) for r in rows} == brute(links)
        assert all((r.path is None) == (r.depth == -1) and (r.path is None or len(r.path) == r.depth + 1) for r in rows)

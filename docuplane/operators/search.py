"""Keyword, vector and hybrid search with filters, facets, sorting and paging, as plans over index rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docuplane.functions import meta as M, text as X, vectors as V

K1, B, RRF = 1.2, 0.75, 60
FACET_VALUES = 100
#: Facet labels in the order they are shown, with the index columns behind them.
FACETS = {"Created": "created_year", "File Type": "content_type", "Document Type": "document_type", "Creator": "creator", "Email Addresses": "email_addresses"}
SORTS = {"date": "created", "size": "file_size"}


@dataclass
class SearchRequest:
    """What a search asks for. filters: facet label -> accepted values; sort: None (relevance) or (field, descending)."""

    query: str = ""
    indices: list[str] = field(default_factory=list)
    limit: int = 20
    offset: int = 0
    filters: dict[str, list[str]] = field(default_factory=dict)
    sort: tuple[str, bool] | None = None

    def checked(self) -> SearchRequest:
        if not 1 <= self.limit <= 200 or not 0 <= self.offset <= 100_000:
            raise ValueError("limit must be 1 to 200, offset at most 100000")
        if self.sort and self.sort[0] not in SORTS:
            raise ValueError(f"sort must be one of {sorted(SORTS)}")
        if len(self.query) > 10_000:
            raise ValueError("query too long")
        return self

    @property
    def wants_facets(self) -> bool:
        return self.offset == 0 or bool(self.filters)


def parse_sort(text: str | None) -> tuple[str, bool] | None:
    """`date:desc` and the like; ValueError for others."""
    if not text:
        return None
    name, _, way = text.partition(":")
    if name not in SORTS or way not in ("asc", "desc"):
        raise ValueError("sort must be date or size, asc or desc")
    return name, way == "desc"


def resolve_indices(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def year_filter(values: list[str], year: Column) -> Column | None:
    """from:Y and to:Y bound the year on both sides, plain years are alternatives; values that are no years are ignored."""
    low = [int(v[5:]) for v in values if v.startswith("from:") and v[5:].lstrip("+-").isdigit()]
    high = [int(v[3:]) for v in values if v.startswith("to:") and v[3:].lstrip("+-").isdigit()]
    plain = [int(v) for v in values if v.lstrip("+-").isdigit()]
    parts = [year >= y for y in low] + [year <= y for y in high] + ([year.isin(plain)] if plain else [])
    return reduce(Column.__and__, parts) if parts else None


def year_any(values: list[str], year: Column) -> Column | None:
    """The other reading of year values: any of them may hold, from:Y and to:Y together as one range."""
    low = [int(v[5:]) for v in values if v.startswith("from:") and v[5:].lstrip("+-").isdigit()]
    high = [int(v[3:]) for v in values if v.startswith("to:") and v[3:].lstrip("+-").isdigit()]
    plain = [int(v) for v in values if v.lstrip("+-").isdigit()]
    bounds = [year >= y for y in low] + [year <= y for y in high]
    parts = ([reduce(Column.__and__, bounds)] if bounds else []) + ([year.isin(plain)] if plain else [])
    return reduce(Column.__or__, parts) if parts else None


def filter_column(filters: dict[str, list[str]], columns: dict[str, str] | None = None, arrays: tuple[str, ...] = ("email_addresses",)) -> Column:
    """All labels must hold, any value of a label; unknown labels and empty lists are ignored."""
    columns = columns or FACETS
    out = F.lit(True)
    for label, values in filters.items():
        if label not in columns or not values:
            continue
        c = F.col(columns[label])
        if label == "Created":
            p = year_filter(values, c)
            out = out & p if p is not None else out
        elif columns[label] in arrays:
            out = out & F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))
        else:
            out = out & c.isin([t for v in values for t in (M.types_of(v) if label == "File Type" else [v])])
    return out


def terms_of(query: str) -> list[str]:
    """Distinct lower-case terms of a query, in order."""
    import re

    return list(dict.fromkeys(w for w in re.split(r"[^\w]|_", query.lower()) if w))


def _is(word: str):
    return lambda x: x == word


def term_figures(docs: DataFrame, terms: list[str], fields: dict[str, Column]) -> DataFrame:
    """docs with the length (__l_) and the frequency of each term (__tf_) of every field's token array; the text isn't needed after."""
    named = docs
    for f, toks in fields.items():
        named = named.withColumn(f"__t_{f}", toks)
    for f in fields:
        t = F.col(f"__t_{f}")
        named = named.withColumn(f"__l_{f}", F.size(t)).withColumn(f"__tf_{f}", F.array(*[F.size(F.filter(t, _is(w))) for w in terms]))
    return named.drop(*[f"__t_{f}" for f in fields])


def score_figures(named: DataFrame, terms: list[str], boosts: dict[str, float]) -> DataFrame:
    """Rows of term_figures() with all terms in a field, with `score`: the sum over fields of boost x BM25, 6 decimals.

    Lengths and frequencies are counted over all rows in one aggregation to a single row, which is joined back; matching and
    scoring need no shuffle and no exploded postings.
    """
    stats = named.agg(
        F.count("*").alias("__n"),
        *[F.avg(f"__l_{f}").alias(f"__avg_{f}") for f in boosts],
        *[F.sum((F.col(f"__tf_{f}")[i] > 0).cast("bigint")).alias(f"__df_{f}_{i}") for f in boosts for i in range(len(terms))],
    )
    every = {f: reduce(Column.__and__, [F.col(f"__tf_{f}")[i] > 0 for i in range(len(terms))]) for f in boosts}
    hit = named.where(reduce(Column.__or__, every.values())).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for f, boost in boosts.items():
        tf = F.col(f"__tf_{f}")
        part = reduce(Column.__add__, [
            F.log(1 + (F.col("__n") - F.col(f"__df_{f}_{i}") + 0.5) / (F.col(f"__df_{f}_{i}") + 0.5)) * tf[i] / (tf[i] + K1 * (1 - B + B * F.col(f"__l_{f}") / F.col(f"__avg_{f}")))
            for i in range(len(terms))
        ])
        score = score + F.when(every[f], F.lit(float(boost)) * part).otherwise(0.0)
    return hit.withColumn("score", F.round(score, 6)).drop(*[c for c in hit.columns if c.startswith("__")])


def bm25(docs: DataFrame, terms: list[str], fields: dict[str, tuple[Column, float]], key: str = "doc_id") -> DataFrame:
    """docs with `score`, the rows with all terms in a field; every row with 0 if there are no terms. fields: token array, boost."""
    if not terms:
        return docs.withColumn("score", F.lit(0.0))
    return score_figures(term_figures(docs, terms, {f: t for f, (t, _) in fields.items()}), terms, {f: b for f, (_, b) in fields.items()})


#: The fields of a text search: content once, the display path twice.
TEXT_FIELDS = {"content": 1.0, "path": 2.0}


def field_tokens() -> dict[str, Column]:
    return {"content": X.tokens(F.col("content")), "path": X.path_tokens(F.col("display_path"))}


def content_score(docs: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """BM25 over content plus twice over the display path."""
    return bm25(docs, terms_of(query), {f: (t, TEXT_FIELDS[f]) for f, t in field_tokens().items()}, key)


def has_terms(query: str) -> Column:
    """Whether all terms stand in the content or all in the path; true for an empty query or *."""
    terms = terms_of(query)
    if not terms:
        return F.lit(True)
    wanted = F.array(*[F.lit(t) for t in terms])
    inside = [F.size(F.array_intersect(wanted, t)) == len(terms) for t in field_tokens().values()]
    return inside[0] | inside[1]


def matches(docs: DataFrame, query: str) -> DataFrame:
    """The rows that a query finds, unranked."""
    return docs.where(has_terms(query))


def ordered(df: DataFrame, sort: tuple[str, bool] | None, key: str = "doc_id") -> DataFrame:
    """By score, or a sort field with nulls last in both directions; ties by the key."""
    if sort is None:
        return df.orderBy(F.desc("score"), key)
    c = F.col(SORTS.get(sort[0], sort[0]))
    return df.orderBy(c.desc_nulls_last() if sort[1] else c.asc_nulls_last(), key)


def page(df: DataFrame, sort: tuple[str, bool] | None, limit: int, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """One page of a global order."""
    return ordered(df, sort, key).offset(offset).limit(limit)


def search(docs: DataFrame, request: SearchRequest, key: str = "doc_id") -> DataFrame:
    """The page of a request over index rows; contents only join the rows of the page, for the snippet."""
    r = request.checked()
    rows = docs.where(F.col("index_name").isin(r.indices)) if r.indices else docs
    hits = content_score(rows, r.query, key).where(filter_column(r.filters))
    top = page(hits.drop("content"), r.sort, r.limit, r.offset, key)
    terms = terms_of(r.query)
    shown = top.join(rows.select(key, "content"), key).withColumn("snippet", X.highlight(X.fragment(F.col("content"), terms), terms)).drop("content")
    return ordered(shown, r.sort, key)


def facet_counts(docs: DataFrame, facets: dict[str, str] | None = None, arrays: tuple[str, ...] = ("email_addresses",), top: int = FACET_VALUES) -> DataFrame:
    """facet, value, n of all facets in one pass: the `top` most frequent values each, ties by value; an array's values once a row."""
    facets = {k: c for k, c in (facets or FACETS).items() if c in docs.columns}
    one = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) if c in arrays else F.array(F.col(c).cast("string"))

    def tagged(k: str, c: str) -> Column:
        return F.transform(one(c), lambda v: F.struct(F.lit(k).alias("facet"), v.alias("value")))

    pairs = F.flatten(F.array(*[tagged(k, c) for k, c in facets.items()]))
    counts = docs.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def merge_facets(*counts: DataFrame) -> DataFrame:
    """Counts of several indices added up."""
    return reduce(DataFrame.unionByName, counts).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def shown_facets(counts: DataFrame) -> DataFrame:
    """facet, place (order shown), shown_values: the values by falling count, ties by value."""
    place = F.coalesce(*[F.when(F.col("facet") == k, F.lit(i)) for i, k in enumerate(FACETS)], F.lit(99))
    lists = counts.where("n > 0").groupBy("facet").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("x"))
    return lists.select("facet", place.alias("place"), F.transform("x", lambda v: v["value"]).alias("shown_values"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, row_key: str = "vec_id", group: Column | None = None, vector: str = "embedding", block: int = 2048) -> DataFrame:
    """query_id, key, score: the k nearest rows (or groups of rows, by their best) of each query by exact cosine similarity.

    queries: query_id, vector. Each block of queries is broadcast (its size is the bound) and met with every row as one matrix
    product per Arrow batch; only each task's best k per query are shuffled. Scores have 6 decimals; ties by key. Filter the rows
    before. Zero and null vectors have no neighbours.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select((group if group is not None else F.col(row_key)).alias("key"), F.col(vector).alias("v"))
    grouped = group is not None
    if rows.schema["key"].dataType.simpleString() != "string":
        rows = rows.withColumn("key", F.col("key").cast("bigint"))
    kind = rows.schema["key"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    numbered = queries.where("vector is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    blocks = max(1, -(-numbered.count() // block))
    found = None
    for b in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        ids = np.array([r.query_id for r in part])
        m = np.array([r.vector for r in part], dtype=np.float64)
        n = np.linalg.norm(m, axis=1)
        shared = spark.sparkContext.broadcast((ids[n > 0], m[n > 0] / n[n > 0, None]))

        def best(batches, shared=shared):
            qi, q = shared.value
            kept: list[dict] = [{} for _ in qi]
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                col = batch.column(1)
                v = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)
                length = np.linalg.norm(v, axis=1)
                good = length > 0
                s = np.round(q @ (v[good] / length[good, None]).T, 6)
                names = keys[good]
                for i, row in enumerate(s):
                    best_of = kept[i]
                    floor = np.sort(row)[-k] if len(row) > k and not grouped else -2.0
                    for j in np.flatnonzero(row >= floor):
                        key = names[j] if kind == "string" else int(names[j])
                        if row[j] > best_of.get(key, -2.0):
                            best_of[key] = float(row[j])
                    if len(best_of) > 4 * k:
                        kept[i] = dict(sorted(best_of.items(), key=lambda x: (-x[1], x[0]))[:k])
            out = [(int(x), key, s) for x, d in zip(qi, kept) for key, s in sorted(d.items(), key=lambda y: (-y[1], y[0]))[:k]]
            if out:
                a, b_, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, arrow), pa.array(c, pa.float64())], ["query_id", "key", "score"])

        hit = rows.mapInArrow(best, f"query_id bigint, key {kind}, score double")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return spark.createDataFrame([], f"query_id bigint, key {kind}, score double, place int")
    merged = found.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return merged.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ranked(df: DataFrame, k: int, key: str) -> DataFrame:
    """key, score and place of the k best rows."""
    top = df.orderBy(F.desc("score"), key).limit(k).select(key, "score")
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse_ranks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: key, score = sum of 1 / (60 + place)."""
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = a.select(key, F.col("place").alias("pa")).join(b.select(key, F.col("place").alias("pb")), key, "full")
    return both.select(key, F.round(part("pa") + part("pb"), 6).alias("score"))


def fuse_weighted(keyword: DataFrame, semantic: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    """(1 - ratio) x keyword score scaled to 0..1 + ratio x (1 + cosine) / 2; what is missing counts 0."""
    bounds = keyword.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = keyword.crossJoin(F.broadcast(bounds)).select(key, F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("kw"))
    both = scaled.join(semantic.select(key, ((1 + F.col("score")) / 2).alias("sem")), key, "full")
    return both.select(key, F.round((1 - ratio) * F.coalesce("kw", F.lit(0.0)) + ratio * F.coalesce("sem", F.lit(0.0)), 6).alias("score"))


def postings(docs: DataFrame, buckets: int = 64, key: str = "doc_id") -> DataFrame:
    """The inverted index as a table: bucket (of the term's hash, for partition pruning), term, key, tf, dl."""
    toks = docs.select(key, X.tokens(F.col("content")).alias("t"))
    rows = toks.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").cast("int").alias("tf"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def score_postings(index: DataFrame, total: int, average: float, terms: list[str], buckets: int = 64, key: str = "doc_id") -> DataFrame:
    """BM25 of the documents with all terms, from a written postings table; only the terms' buckets are read."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    read = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    hit = index.where(F.col("bucket").isin(read) & F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    scored = hit.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("n"))
    return scored.where(F.col("n") == len(terms)).select(key, F.round("score", 6).alias("score"))


def one_model(registry: DataFrame, indices: list[str]) -> tuple[str, str]:
    """The embedding model and backend all indices share; ValueError if one has none or they differ."""
    rows = {r.index_name: (r.model, r.backend) for r in registry.where(F.col("index_name").isin(indices)).select("index_name", "model", "backend").collect()}
    if missing := [i for i in indices if i not in rows]:
        raise ValueError(f"no embeddings: {', '.join(missing)}")
    if len(set(rows.values())) != 1:
        raise ValueError("the indices were embedded with different models")
    return next(iter(rows.values()))

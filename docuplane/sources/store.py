"""The index store: Parquet tables in a folder, one partition per index; all writes replace whole rows or partitions.

A table is a version (a whole) and its deltas, in each of which every doc_id stands for all its rows. Writes add a delta; readers
take of each doc_id the rows of its last delta, else those of the version. After DELTAS of them, or when they hold a share of the
rows, the table is written as a new version. So ingesting in batches writes each row a few times, not once a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docuplane.operators.index import state_check, upsert


#: Deltas beside a version, and the part of its rows they may hold, before they are merged into a new one.
DELTAS, PART = 8, 0.5


class Store:
    """root/docs and root/chunks, partitioned by index_name. Readers see whole files: a rewrite goes to a new version folder, and the
    version before it stays until the next rewrite, for plans that still read it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, index: str, kind: str) -> list[str]:
        """The finished versions and deltas of a table, by name."""
        p, fs = self._fs(f"{self.root}/{kind}/index_name={index}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, f"{n}/_SUCCESS")))

    def _current(self, index: str, kind: str) -> str | None:
        whole = [n for n in self._names(index, kind) if "-" not in n]
        return f"{self.root}/{kind}/index_name={index}/{whole[-1]}" if whole else None

    def _deltas(self, index: str, kind: str) -> list[str]:
        now = self._current(index, kind)
        return [f"{self.root}/{kind}/index_name={index}/{n}" for n in self._names(index, kind) if now and n.startswith(now.rsplit("/", 1)[1] + "-")]

    def _table(self, index: str, kind: str) -> DataFrame | None:
        """The rows of a table: of each doc_id those of its last delta, else those of the version; rows without `chunk_no` only say that the
        vectors of their doc_id are gone."""
        now, deltas = self._current(index, kind), self._deltas(index, kind)
        if now is None:
            return None
        whole = self.spark.read.parquet(now)
        if not deltas:
            return whole
        new = None
        for k, at in enumerate(deltas):
            d = self.spark.read.parquet(at).withColumn("__delta", F.lit(k))
            new = d if new is None else new.unionByName(d, allowMissingColumns=True)
        last = new.groupBy("doc_id").agg(F.max("__delta").alias("__delta"))
        new = new.join(last, ["doc_id", "__delta"], "left_semi").drop("__delta")
        if kind == "chunks":
            new = new.where("chunk_no is not null")
        return whole.join(last, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)

    def _write(self, df: DataFrame, index: str, kind: str) -> None:
        now = self._current(index, kind)
        n = int(now.rsplit("v", 1)[1]) + 1 if now else 1
        df.drop("index_name").write.parquet(f"{self.root}/{kind}/index_name={index}/v{n:06d}")
        for name in self._names(index, kind):
            if int(name[1:7]) < n - 1:
                p, fs = self._fs(f"{self.root}/{kind}/index_name={index}/{name}")
                fs.delete(p, True)

    def _add(self, df: DataFrame, index: str, kind: str) -> None:
        """df as a delta, or as the first version; deltas that have become many or large are merged."""
        now = self._current(index, kind)
        if now is None:
            self._write(df.where("chunk_no is not null") if kind == "chunks" else df, index, kind)
            return
        deltas = self._deltas(index, kind)
        df.drop("index_name").write.parquet(f"{now}-{len(deltas) + 1:06d}")
        p, fs = self._fs(now)
        size = lambda at: fs.getContentSummary(self._fs(at)[0]).getLength()
        if len(deltas) + 1 >= DELTAS or sum(map(size, self._deltas(index, kind))) > PART * size(now):
            self._write(self._table(index, kind), index, kind)

    def indices(self) -> list[str]:
        """Names of the indices, without hidden ones, sorted."""
        p, fs = self._fs(f"{self.root}/docs")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName().removeprefix("index_name=") for s in fs.listStatus(p)]
        return sorted(n for n in names if not n.startswith(".") and self._current(n, "docs"))

    def docs(self, *indices: str) -> DataFrame | None:
        """The rows of the named indices, all if none is named; None if there are none."""
        out = None
        for i in indices or self.indices():
            if (t := self._table(i, "docs")) is not None:
                t = t.withColumn("index_name", F.lit(i))
                out = t if out is None else out.unionByName(t, allowMissingColumns=True)
        return out

    def create(self, index: str, schema: dict[str, str]) -> bool:
        """Make an index; one whose columns have other types is dropped and made anew. True if rows were lost."""
        have = self.docs(index)
        if have is not None and not state_check(have, schema):
            return False
        lost = have is not None
        self.delete(index)
        self._write(self.spark.createDataFrame([], ", ".join(f"`{k}` {t}" for k, t in schema.items())), index, "docs")
        return lost

    def put(self, df: DataFrame, index: str) -> None:
        """Replace or add whole rows by doc_id; vectors of replaced rows are dropped."""
        rows = df.withColumn("has_embeddings", F.lit(False)).drop("index_name")
        self._add(upsert(rows.limit(0), rows), index, "docs")
        if (vectors := self.chunks(index)) is not None:
            gone = vectors.select("doc_id").distinct().join(df.select("doc_id"), "doc_id", "left_semi")
            none = [F.lit(None).cast(t).alias(c) for c, t in vectors.dtypes if c != "doc_id"]
            self._add(gone.select("doc_id", *none), index, "chunks")

    def put_chunks(self, chunks: DataFrame, index: str) -> None:
        """Vectors (doc_id, chunk_no, embedding) of documents, in place of their old ones."""
        self._add(chunks, index, "chunks")

    def chunks(self, index: str) -> DataFrame | None:
        return self._table(index, "chunks")

    def unembedded(self, index: str) -> DataFrame | None:
        """Rows without vectors."""
        docs, c = self.docs(index), self.chunks(index)
        return docs if docs is None or c is None else docs.join(c.select("doc_id").distinct(), "doc_id", "left_anti")

    def clear_chunks(self, index: str) -> None:
        p, fs = self._fs(f"{self.root}/chunks/index_name={index}")
        fs.delete(p, True)

    def delete(self, index: str) -> None:
        """Drop an index; one that isn't there is no error."""
        for kind in ("docs", "chunks"):
            p, fs = self._fs(f"{self.root}/{kind}/index_name={index}")
            fs.delete(p, True)


def count_only(df: DataFrame) -> int:
    """A sink that keeps nothing: runs the plan, returns the rows."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]

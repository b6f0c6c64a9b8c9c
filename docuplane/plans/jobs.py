"""Queries of jobs, errors, the registry, permissions and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuplane.operators import index as I, jobs as J
from docuplane.session import bounded_broadcast, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_JOBS = "(SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY coalesce(finished_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, created_at DESC, total_files DESC) = 1)"
#: Users: all customers; permissions: user k may see an index where (k + place of the index) % 7 = 0, every 50th all.
_USERS = "(SELECT 'user' || c_custkey AS user_name, c_custkey AS k FROM customer)"
_PERMISSIONS = f"(SELECT user_name, index_name FROM {_USERS} u, (SELECT index_name, row_number() OVER (ORDER BY index_name) AS n FROM index_profiles) i WHERE (k + n) % 7 = 0 UNION ALL SELECT user_name, '*' FROM {_USERS} WHERE k % 50 = 0)"


def permissions(spark, d):
    from pyspark.sql import Window

    users = table(spark, d, "customer").select(F.concat(F.lit("user"), "c_custkey").alias("user_name"), F.col("c_custkey").alias("k"))
    n = table(spark, d, "index_profiles").select("index_name", F.row_number().over(Window.orderBy("index_name")).alias("n"))
    own = users.join(bounded_broadcast(n, 100_000), (F.col("k") + F.col("n")) % 7 == 0).select("user_name", "index_name")
    return own.unionByName(users.where("k % 50 = 0").select("user_name", F.lit("*").alias("index_name")))


@query("SELECT job_id, file_path, error_type, error_ts FROM job_errors QUALIFY row_number() OVER (PARTITION BY job_id, file_path, error_type ORDER BY error_ts, message NULLS LAST) = 1")
def errors_dedup_first(spark, d):
    return J.first_errors(table(spark, d, "job_errors")).select("job_id", "file_path", "error_type", "error_ts")


@query("SELECT DISTINCT job_id, file_path FROM job_errors WHERE error_type NOT IN ('EmptyExtraction', 'ContentTruncated')")
def errors_exclude(spark, d):
    return J.failed_paths(table(spark, d, "job_errors"), exclude=("EmptyExtraction", "ContentTruncated"))


@query("SELECT DISTINCT job_id, file_path FROM job_errors WHERE error_type = 'EmptyExtraction'")
def errors_only(spark, d):
    return J.failed_paths(table(spark, d, "job_errors"), only="EmptyExtraction")


@query("SELECT DISTINCT job_id, file_path FROM job_errors")
def distinct_failed(spark, d):
    return J.failed_paths(table(spark, d, "job_errors"))


@query("SELECT job_id, error_type, count(*) AS n FROM job_errors GROUP BY ALL")
def errors_by_type(spark, d):
    return table(spark, d, "job_errors").groupBy("job_id", "error_type").agg(F.count("*").alias("n"))


@query("SELECT job_id, status, created_at FROM jobs WHERE lower(trim(status)) = 'completed'")
def jobs_by_status(spark, d):
    return table(spark, d, "jobs").where(J.state(F.col("status")) == "completed").select("job_id", "status", "created_at")


@query(f"SELECT source_dir, arg_max(job_id, (created_at, job_id)) AS job_id FROM {_JOBS} WHERE lower(trim(status)) IN ('interrupted', 'failed', 'running') AND job_type = 'ingest' GROUP BY source_dir")
def resumable_jobs(spark, d):
    return J.resumable(table(spark, d, "jobs"))


@query(f"SELECT j.job_id FROM {_JOBS} j WHERE lower(trim(status)) IN ('running', 'pending', 'failed', 'interrupted', 'completed') AND NOT EXISTS (SELECT 1 FROM jobs l JOIN index_profiles p USING (index_name) WHERE p.main_lang = 'de' AND l.source_dir = j.source_dir)")
def stale_jobs(spark, d):
    """Jobs in any state whose folder nobody holds, as if all claimed to run; folders of German indices are held."""
    jobs = table(spark, d, "jobs")
    held = table(spark, d, "index_profiles").where("main_lang = 'de'").select("index_name")
    locks = jobs.join(held, "index_name", "left_semi").select("source_dir").distinct()
    return J.stale(jobs, locks, J.STATES).select("job_id")


@query(f"SELECT j.job_id, CAST(sum(CASE WHEN e.n IS NULL THEN 0 ELSE e.n END) AS BIGINT) AS errors, max(j.extracted) AS extracted, max(j.processed) AS processed, max(j.failed) AS failed, max(j.n_empty) AS n_empty, max(j.skipped) AS skipped FROM {_JOBS} j LEFT JOIN (SELECT job_id, count(*) AS n FROM (SELECT DISTINCT job_id, file_path, error_type FROM job_errors) GROUP BY job_id) e USING (job_id) GROUP BY j.job_id")
def job_progress(spark, d):
    e = table(spark, d, "job_errors").select("job_id", "file_path", "error_type").distinct().groupBy("job_id").agg(F.count("*").alias("errors"))
    j = J.distinct_jobs(table(spark, d, "jobs"))
    return j.join(e, "job_id", "left").select("job_id", F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"), "extracted", "processed", "failed", "n_empty", "skipped")


@query(f"SELECT job_id, round(epoch(finished_at - created_at), 3) AS seconds, round(CASE WHEN epoch(finished_at - created_at) > 0 THEN processed / epoch(finished_at - created_at) ELSE 0 END, 6) AS per_second FROM {_JOBS} WHERE finished_at IS NOT NULL")
def job_throughput(spark, d):
    j = J.distinct_jobs(table(spark, d, "jobs")).where("finished_at is not null")
    s = (F.unix_micros("finished_at") - F.unix_micros("created_at")) / 1e6
    return j.select("job_id", F.round(s, 3).alias("seconds"), F.round(F.when(s > 0, F.col("processed") / s).otherwise(0.0), 6).alias("per_second"))


@query("SELECT index_name, source_path FROM index_docs GROUP BY ALL HAVING bool_and(coalesce(content, '') = '')")
def all_empty_files(spark, d):
    return table(spark, d, "index_docs").groupBy("index_name", "source_path").agg(F.bool_and(F.coalesce("content", F.lit("")) == "").alias("e")).where("e").drop("e")


@query("SELECT index_name, model, backend, dimension, context_length FROM index_embeddings QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY updated_at DESC, model DESC, backend DESC) = 1")
def registry_latest(spark, d):
    return J.latest_models(table(spark, d, "index_embeddings")).select("index_name", "model", "backend", "dimension", "context_length")


@query("WITH l AS (SELECT * FROM index_embeddings QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY updated_at DESC, model DESC, backend DESC) = 1) SELECT main_lang, count(DISTINCT (model, backend)) = 1 AND count(*) = count(model) AS one_model FROM index_profiles LEFT JOIN l USING (index_name) GROUP BY main_lang")
def model_consistency(spark, d):
    l = J.latest_models(table(spark, d, "index_embeddings")).select("index_name", "model", "backend")
    p = table(spark, d, "index_profiles").join(l, "index_name", "left")
    return p.groupBy("main_lang").agg(((F.count_distinct("model", "backend") == 1) & (F.count("*") == F.count("model"))).alias("one_model"))


@query("WITH l AS (SELECT * FROM index_embeddings QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY updated_at DESC, model DESC, backend DESC) = 1) SELECT p.index_name, coalesce(l.dimension, 0) > 0 AS has_embeddings FROM index_profiles p LEFT JOIN l USING (index_name)")
def index_embedding_flags(spark, d):
    l = J.latest_models(table(spark, d, "index_embeddings")).select("index_name", "dimension")
    return table(spark, d, "index_profiles").join(bounded_broadcast(l, 100_000), "index_name", "left").select("index_name", (F.coalesce("dimension", F.lit(0)) > 0).alias("has_embeddings"))


@query("WITH l AS (SELECT * FROM index_embeddings QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY updated_at DESC, model DESC, backend DESC) = 1) SELECT main_lang, bool_and(coalesce(l.dimension, 0) > 0) AS hybrid FROM index_profiles p LEFT JOIN l USING (index_name) GROUP BY main_lang")
def hybrid_enabled(spark, d):
    return index_embedding_flags(spark, d).join(table(spark, d, "index_profiles").select("index_name", "main_lang"), "index_name").groupBy("main_lang").agg(F.bool_and("has_embeddings").alias("hybrid"))


@query(f"SELECT p.index_name, u.user_name FROM {_USERS} u JOIN {_PERMISSIONS} p USING (user_name)")
def join_index_users(spark, d):
    users = table(spark, d, "customer").select(F.concat(F.lit("user"), "c_custkey").alias("user_name"))
    return users.join(permissions(spark, d), "user_name").select("index_name", "user_name")


@query(f"SELECT index_name FROM index_profiles WHERE index_name IN (SELECT index_name FROM {_PERMISSIONS} WHERE user_name = 'user3')")
def visible_indices(spark, d):
    return J.visible_indices(table(spark, d, "index_profiles").select("index_name"), permissions(spark, d), "user3")


@query(f"SELECT index_name FROM index_profiles WHERE EXISTS (SELECT 1 FROM {_PERMISSIONS} WHERE user_name = 'user50' AND index_name = '*') OR index_name IN (SELECT index_name FROM {_PERMISSIONS} WHERE user_name = 'user50')")
def visible_indices_all(spark, d):
    return J.visible_indices(table(spark, d, "index_profiles").select("index_name"), permissions(spark, d), "user50")


@query("SELECT job_id, file_path, error_type FROM job_errors WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE index_name = 'quay_ledger')")
def cascade_delete_anti(spark, d):
    return J.without_index(table(spark, d, "jobs"), table(spark, d, "job_errors"), "quay_ledger")[1].select("job_id", "file_path", "error_type")


@query("SELECT DISTINCT source_dir FROM jobs WHERE index_name = 'quay_ledger' AND job_type = 'ingest'")
def source_dirs(spark, d):
    return table(spark, d, "jobs").where("index_name = 'quay_ledger' and job_type = 'ingest'").select("source_dir").distinct()


@query("SELECT DISTINCT replace(file_path, '\\', '/') AS file_path FROM job_errors WHERE replace(file_path, '\\', '/') NOT IN (SELECT source_path FROM index_docs WHERE coalesce(extracted_from, '') = '' AND source_path IS NOT NULL)")
def resume_anti(spark, d):
    paths = table(spark, d, "job_errors").select(F.regexp_replace("file_path", r"\\", "/").alias("file_path")).where("file_path is not null").distinct()
    done = table(spark, d, "index_docs").where("coalesce(extracted_from, '') = ''").select(F.col("source_path").alias("file_path"))
    return paths.join(done, "file_path", "left_anti")


@query("SELECT DISTINCT source_path FROM index_docs WHERE source_path IN (SELECT replace(file_path, '\\', '/') FROM job_errors WHERE error_type <> 'EmptyExtraction')")
def existing_semi(spark, d):
    """Paths of the index that stand in the error log with more than an empty extraction."""
    failed = J.failed_paths(table(spark, d, "job_errors"), exclude=("EmptyExtraction",)).select(F.regexp_replace("file_path", r"\\", "/").alias("source_path"))
    return table(spark, d, "index_docs").join(failed, "source_path", "left_semi").select("source_path").distinct()


@query("SELECT event_id, earlier, earlier >= 5 AS blocked FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 899999999 PRECEDING AND 1 PRECEDING) AS earlier FROM events)")
def sliding_rate_limit(spark, d):
    return J.blocked(table(spark, d, "events"), "user_id", "ts").select("event_id", "earlier", "blocked")


@query("SELECT event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run_no ORDER BY ts, event_id) AS BIGINT) AS failures FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM (SELECT *, value >= 20 AS ok FROM events))")
def consecutive_failures(spark, d):
    t = J.failure_runs(table(spark, d, "events"), "user_id", "ts", F.col("value") >= 20, "event_id")
    return t.select("event_id", F.col("failures").cast("bigint").alias("failures"))


#: Sessions: one per order, until so many days after it as the customer's key modulo 60; now is the start of 1997.
_NOW = "1997-01-01 00:00:00"


def _sessions(spark, d):
    until = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((F.col("o_custkey") % 60).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("token"), until.alias("expires_at"))


@query(f"SELECT o_orderkey AS token FROM orders WHERE o_orderdate + to_days(CAST(o_custkey % 60 AS INTEGER)) > TIMESTAMP '{_NOW}'")
def sessions_valid(spark, d):
    return _sessions(spark, d).where(J.session_valid(F.col("expires_at"), F.lit(_NOW).cast("timestamp"))).select("token")


@query(f"SELECT count(*) AS gone FROM orders WHERE o_orderdate + to_days(CAST(o_custkey % 60 AS INTEGER)) <= TIMESTAMP '{_NOW}'")
def sessions_purged(spark, d):
    return _sessions(spark, d).agg(F.count_if(~J.session_valid(F.col("expires_at"), F.lit(_NOW).cast("timestamp"))).alias("gone"))


@query("SELECT event_id, CASE WHEN contains(ip, ':') THEN array_to_string(string_split(ip, ':')[1:4], ':') ELSE ip END AS k FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.' || user_id || '.7' ELSE '2001:db8:' || user_id || ':1:2:3:4:5' END AS ip FROM events)")
def rate_limit_key(spark, d):
    ip = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0."), "user_id", F.lit(".7"))).otherwise(F.concat(F.lit("2001:db8:"), "user_id", F.lit(":1:2:3:4:5")))
    return table(spark, d, "events").select("event_id", J.rate_key(ip).alias("k"))


@query("SELECT event_id, array_to_string((list_concat(string_split(split_part(ip, '::', 1), ':'), list_transform(range(7 - len(string_split(split_part(ip, '::', 1), ':'))), lambda i: '0')))[1:4], ':') AS k FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fe80::' || user_id WHEN 1 THEN '2001:db8:' || user_id || '::9' ELSE '2001:db8::' || user_id END AS ip FROM events)")
def rate_limit_key_short(spark, d):
    """Keys of shortened IPv6 addresses."""
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    ip = F.when(k == 0, F.concat(F.lit("fe80::"), u)).when(k == 1, F.concat(F.lit("2001:db8:"), u, F.lit("::9"))).otherwise(F.concat(F.lit("2001:db8::"), u))
    return table(spark, d, "events").select("event_id", J.rate_key(ip).alias("k"))


@query("SELECT event_id, coalesce(lag(failures) OVER w >= 3 AND epoch_us(ts) - lag(epoch_us(ts)) OVER w < 60000000, false) AS open FROM (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id % 5, run_no ORDER BY ts, event_id) AS BIGINT) AS failures FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS run_no FROM (SELECT *, value >= 50 AS ok FROM events))) WINDOW w AS (PARTITION BY user_id % 5 ORDER BY ts, event_id)")
def health_breaker(spark, d):
    """Five servers that answer the events; a value below 50 is a failure."""
    t = table(spark, d, "events").withColumn("server", F.col("user_id") % 5)
    return J.breaker(t, "server", "ts", F.col("value") >= 50, "event_id").select("event_id", "open")


@query("SELECT event_type, count(*) AS files, round(sum(value), 4) AS seconds, max(value) AS slowest FROM events GROUP BY event_type")
def extraction_seconds(spark, d):
    return J.extraction_seconds(table(spark, d, "events"), "event_type", F.col("value")).withColumn("seconds", F.round("seconds", 4))


@query(f"SELECT job_id, CAST(done AS BIGINT) AS done, round(CASE WHEN total_files > 0 THEN least(done / total_files, 1.0) END, 6) AS share, round(CASE WHEN done > 0 AND s > 0 THEN greatest(total_files - done, 0) * s / done END, 3) AS seconds_left FROM (SELECT *, coalesce(processed, 0) + coalesce(failed, 0) + coalesce(n_empty, 0) + coalesce(skipped, 0) AS done, epoch(coalesce(finished_at, TIMESTAMPTZ '2025-01-01 00:00:00+00') - created_at) AS s FROM {_JOBS})")
def progress_snapshot(spark, d):
    t = J.progress(table(spark, d, "jobs"), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return t.select("job_id", "done", F.round("share", 6).alias("share"), F.round("seconds_left", 3).alias("seconds_left"))

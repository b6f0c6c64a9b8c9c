"""Jobs, errors, the embeddings registry and access rights as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STATES = ("pending", "running", "completed", "failed", "interrupted")


def state(status: Column) -> Column:
    return F.lower(F.trim(status))


def distinct_jobs(jobs: DataFrame) -> DataFrame:
    """One row per job: the one that ended last (an unfinished one before all)."""
    cols = [c for c in jobs.columns if c != "job_id"]
    last = jobs.groupBy("job_id").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("finished_at", F.lit("1970-01-01").cast("timestamp")), "created_at", "total_files")).alias("x"))
    return last.select("job_id", "x.*")


def first_errors(errors: DataFrame) -> DataFrame:
    """One row per (job, path, type): the first recorded; ties by message."""
    w = Window.partitionBy("job_id", "file_path", "error_type").orderBy("error_ts", F.col("message").asc_nulls_last())
    return errors.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def failed_paths(errors: DataFrame, only: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """job_id, file_path with at least one error of the wanted kind; all kinds if nothing is named."""
    rows = errors
    if only is not None:
        rows = rows.where(F.col("error_type") == only)
    elif exclude:
        rows = rows.where(~F.col("error_type").isin(*exclude))
    return rows.select("job_id", "file_path").distinct()


def resumable(jobs: DataFrame, job_type: str = "ingest") -> DataFrame:
    """Per source folder the newest job that was cut short."""
    rows = distinct_jobs(jobs).where(state(F.col("status")).isin("interrupted", "failed", "running") & (F.col("job_type") == job_type))
    return rows.groupBy("source_dir").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def latest_models(registry: DataFrame) -> DataFrame:
    """One row per index: the last setting, ties by model and backend."""
    cols = [c for c in registry.columns if c != "index_name"]
    last = registry.groupBy("index_name").agg(F.max_by(F.struct(*cols), F.struct("updated_at", "model", "backend")).alias("x"))
    return last.select("index_name", "x.*")


def without_index(jobs: DataFrame, errors: DataFrame, index: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and errors after an index is cleared: its jobs, and the errors of those."""
    gone = jobs.where(F.col("index_name") == index).select("job_id").distinct()
    return jobs.where(F.col("index_name") != index), errors.join(gone, "job_id", "left_anti")


def stale(jobs: DataFrame, locks: DataFrame, states: tuple[str, ...] = ("running", "pending")) -> DataFrame:
    """Jobs that claim to be in one of the states although nobody holds the lock (source_dir) of their folder."""
    return distinct_jobs(jobs).where(state(F.col("status")).isin(*states)).join(locks, "source_dir", "left_anti")


def embed_guard(current: tuple[str, str, int] | None, wanted: tuple[str, str, int], force: bool = False) -> bool:
    """Whether vectors must be cleared before embedding; ValueError if the model changes without force."""
    if current is None or current == wanted:
        return False
    if not force:
        raise ValueError("the index was embedded with another model; use force to start over")
    return True


def visible_indices(indices: DataFrame, permissions: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Indices a user may list and search: all for admins and for a * permission."""
    if admin:
        return indices
    own = permissions.where(F.col("user_name") == user)
    every = own.where("index_name = '*'").limit(1).count() > 0
    return indices if every else indices.join(own.select("index_name"), "index_name", "left_semi")


def blocked(events: DataFrame, key: str, ts: str, failures: int = 5, window_s: int = 900) -> DataFrame:
    """events with `blocked`: whether `failures` or more failures of the key lie in the open window before the event."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(window_s * 1_000_000 - 1), -1)
    return events.withColumn("earlier", F.count("*").over(w)).withColumn("blocked", F.col("earlier") >= failures)


def rate_key(ip: Column) -> Column:
    """IPv4 as it is, IPv6 by its first four groups; `::` stands for as many groups of 0 as are missing."""
    parts = F.split(ip, "::", 2)
    groups = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    left, right = groups(parts[0]), groups(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    gap = F.greatest(8 - F.size(left) - F.size(right), F.lit(0))
    whole = F.when(ip.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), gap), right)).otherwise(F.split(ip, ":"))
    return F.when(ip.contains(":"), F.array_join(F.slice(whole, 1, 4), ":")).otherwise(ip)


def breaker(events: DataFrame, key: str, ts: str, ok: Column, order: str, most: int = 3, pause_s: int = 60) -> DataFrame:
    """failure_runs() with `open`: whether the key counts as down at the event, that is after `most` failures in a row until `pause_s`
    seconds after the last of them, when it's tried again."""
    t = failure_runs(events, key, ts, ok, order)
    w = Window.partitionBy(key).orderBy(ts, order)
    before, last = F.lag("failures").over(w), F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    down = (before >= most) & (F.unix_micros(F.col(ts).cast("timestamp")) - last < pause_s * 1_000_000)
    return t.withColumn("open", F.coalesce(down, F.lit(False)))


def extraction_seconds(events: DataFrame, key: str, value: Column) -> DataFrame:
    """key, files, seconds, slowest: what extraction took in all and at most."""
    return events.groupBy(key).agg(F.count("*").alias("files"), F.sum(value).alias("seconds"), F.max(value).alias("slowest"))


def progress(jobs: DataFrame, now: Column) -> DataFrame:
    """distinct_jobs() with done (files dealt with), share of all, seconds so far and seconds_left at this rate (null before the first)."""
    end = F.coalesce(F.col("finished_at"), now)
    s = (F.unix_micros(end) - F.unix_micros("created_at")) / 1e6
    done = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("processed", "failed", "n_empty", "skipped")), F.lit(0))
    t = distinct_jobs(jobs).withColumn("done", done.cast("bigint")).withColumn("seconds", s)
    left = F.greatest(F.col("total_files") - F.col("done"), F.lit(0))
    return t.withColumn("share", F.when(F.col("total_files") > 0, F.least(F.col("done") / F.col("total_files"), F.lit(1.0)))).withColumn("seconds_left", F.when((F.col("done") > 0) & (F.col("seconds") > 0), left * F.col("seconds") / F.col("done")))


def failure_runs(events: DataFrame, key: str, ts: str, ok: Column, order: str) -> DataFrame:
    """events with `run_no` and `failures`: consecutive failures of the key since its last success."""
    w = Window.partitionBy(key).orderBy(ts, order)
    marked = events.withColumn("ok", ok).withColumn("run_no", F.sum(F.col("ok").cast("int")).over(w))
    r = Window.partitionBy(key, "run_no").orderBy(ts, order)
    return marked.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(r))


def password_ok(p: Column, least: int = 8) -> Column:
    """Length, lower and upper case, a digit and a special character."""
    return (F.length(p) >= least) & p.rlike("[a-z]") & p.rlike("[A-Z]") & p.rlike("[0-9]") & p.rlike("[^A-Za-z0-9]")


def session_valid(expires: Column, now: Column) -> Column:
    return expires > now

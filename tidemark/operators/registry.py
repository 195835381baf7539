"""The source registry: catalogue, status, scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import mirror_slug


def allowed(sources: DataFrame, source_type: str | None = None) -> DataFrame:
    """Active sources whose policy allows them, of one type if given."""
    out = sources.filter((F.col("active")) & (F.col("policy") == "allow"))
    return out if source_type is None else out.filter(F.col("source_type") == source_type)


def list_repos(sources: DataFrame) -> DataFrame:
    """(repo, source_type) of all allowed sources in (source_type, name) order; a git repository
    goes by its mirror slug."""
    repo = F.when(F.col("source_type") == "git_repo", mirror_slug(F.col("config"), F.col("name"))).otherwise(F.col("name"))
    return allowed(sources).orderBy("source_type", "name").select(repo.alias("repo"), "source_type")


def resolve(sources: DataFrame, repo: str | None) -> DataFrame:
    """(id, repo) of allowed git sources, of one slug if given; no row if it isn't registered."""
    slugs = allowed(sources, "git_repo").select("id", mirror_slug(F.col("config"), F.col("name")).alias("repo"))
    return slugs if repo is None else slugs.filter(F.col("repo") == repo)


def source_status(sources: DataFrame, chunks: DataFrame, pending: DataFrame) -> DataFrame:
    """Sources with how many chunks and staged rows they have, in (source_type, name) order."""
    count = lambda df, name: df.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias(name))
    out = sources.join(count(chunks, "chunks"), "id", "left").join(count(pending, "pending"), "id", "left")
    return out.select("id", "source_type", "name", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("pending", F.lit(0)).alias("pending")).orderBy("source_type", "name")


#: Minutes between two syncs of a source.
PERIODS = {"git_repo": 15, "jira_project": 60, "drive_folder": 30}
#: Days that finished jobs are kept, and minutes after which a running one counts as lost.
KEPT_DAYS, LOST_MINUTES = 14, 20
FINAL = ("completed", "cancelled", "discarded")


def due(sources: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """(source_id, source_type) of allowed sources that weren't synced within their type's period."""
    last = states.groupBy(F.col("source_id").alias("id")).agg(F.max("last_synced_at").alias("last"))
    minutes = F.create_map(*(F.lit(x) for pair in PERIODS.items() for x in pair))[F.col("source_type")]
    some = allowed(sources).join(last, "id", "left")
    late = F.col("last").isNull() | (F.col("last") + F.make_dt_interval(mins=minutes) <= now)
    return some.filter(late).select(F.col("id").alias("source_id"), "source_type")


def outcomes(attempts: DataFrame) -> DataFrame:
    """Job attempts(id, attempt, max_attempts, error, snooze_seconds, cancel_reason) with the state
    that follows: a cancelled job ends, a snoozed one waits without using up an attempt, a failed
    one is tried again until its attempts are used up."""
    state = (
        F.when(F.col("cancel_reason").isNotNull(), "cancelled")
        .when(F.col("snooze_seconds").isNotNull(), "scheduled")
        .when(F.col("error").isNull(), "completed")
        .when(F.col("attempt") < F.col("max_attempts"), "retryable")
        .otherwise("discarded")
    )
    used = F.when(F.col("snooze_seconds").isNotNull() & F.col("cancel_reason").isNull(), F.col("attempt") - 1).otherwise(F.col("attempt"))
    return attempts.withColumn("state", state).withColumn("attempt", used)


def prune_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs(id, state, at, ...) without those that ended over KEPT_DAYS ago; one that has been running
    for LOST_MINUTES is available again."""
    old = F.col("state").isin(*FINAL) & (F.col("at") < now - F.expr(f"INTERVAL {KEPT_DAYS} DAYS"))
    lost = (F.col("state") == "executing") & (F.col("at") < now - F.expr(f"INTERVAL {LOST_MINUTES} MINUTES"))
    return jobs.filter(~F.coalesce(old, F.lit(False))).withColumn("state", F.when(lost, "available").otherwise(F.col("state")))


def jobs_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("jobs"))

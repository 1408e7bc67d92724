"""Run history and model versions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.columns import all_of

VERSION_COLUMNS = ["model_id", "model_type", "version", "registered_at", "deployment_stage", "performance_metrics", "tags"]


def metric(name: str) -> Column:
    """A metric of the version; a missing one is 0."""
    return F.coalesce(F.try_element_at("performance_metrics", F.lit(name)), F.lit(0.0))


def find_versions(
    versions: DataFrame,
    stage: str | None = None,
    model_type: str | None = None,
    tags: tuple[str, ...] = (),
    min_metrics: dict[str, float] | None = None,
) -> DataFrame:
    """Versions in a stage that carry all ``tags`` and reach every minimum metric."""
    wanted = [F.array_contains("tags", t) for t in tags]
    wanted += [metric(m) >= low for m, low in (min_metrics or {}).items()]
    if stage is not None:
        wanted.append(F.col("deployment_stage") == stage)
    if model_type is not None:
        wanted.append(F.col("model_type") == model_type)
    found = versions.where(all_of(wanted)) if wanted else versions
    return found.select(*[c for c in VERSION_COLUMNS if c in versions.columns])


def latest_version(versions: DataFrame, **filters) -> DataFrame:
    """The most recently registered version that passes the filters (one row at most)."""
    newest = F.max_by(F.struct("*"), F.struct("registered_at", "model_id"))
    return find_versions(versions, **filters).agg(newest.alias("v")).where("v is not null").select("v.*")


def compare_versions(versions: DataFrame, ids: list, metrics: list[str]) -> DataFrame:
    """One row per known id and one column per metric; NULL where a version lacks it."""
    return versions.where(F.col("model_id").isin(ids)).select(
        "model_id", *[F.try_element_at("performance_metrics", F.lit(m)).alias(m) for m in metrics]
    )


def retained(versions: DataFrame, keep: int) -> DataFrame:
    """Versions kept per type: all in production, and of the others the newest
    ``keep`` minus the number in production (at least 0).

    The rank filter is a group limit of ``keep`` rows per type, so a type with many
    versions is cut before the shuffle; production counts are a plain aggregate.
    """
    production = F.col("deployment_stage") == "production"
    counts = versions.groupBy("model_type").agg(F.count_if(production).alias("_prod"))
    newest = Window.partitionBy("model_type").orderBy(F.desc("registered_at"), F.desc("model_id"))
    others = versions.where(~production).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= keep)
    room = F.greatest(F.lit(0), F.lit(keep) - F.col("_prod"))
    kept = others.join(counts, "model_type").where(F.col("_rn") <= room).drop("_rn", "_prod")
    return versions.where(production).unionByName(kept)


def current_state(events: DataFrame, key: str = "model_id") -> DataFrame:
    """Versions alive after an append-only log of ``key, event_time, event, stage, force``.

    The newest ``stage`` event sets the stage. A later ``delete`` removes the version;
    one in production is removed only by a forced delete. Plain maxima per key, so a
    version with a long log is combined map-side.
    """

    def newest(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("event_time")))

    staged, deleted = F.col("event") == "stage", F.col("event") == "delete"
    state = events.groupBy(key).agg(
        F.max_by(
            F.when(staged, F.col("stage")), F.when(staged, F.struct("event_time", "stage"))
        ).alias("stage"),
        newest(staged).alias("_staged"),
        newest(deleted).alias("_deleted"),
        newest(deleted & F.col("force")).alias("_forced"),
    )
    removal = F.when(F.col("stage") == "production", F.col("_forced")).otherwise(F.col("_deleted"))
    gone = F.coalesce(removal > F.col("_staged"), F.lit(False))
    return state.where(F.col("_staged").isNotNull() & ~gone).select(key, "stage")


MAX_LISTED = 100


def list_runs(log: DataFrame, limit: int) -> DataFrame:
    """Newest runs first; between 1 and 100 of them."""
    if not 1 <= limit <= MAX_LISTED:
        raise ValueError(f"limit must be between 1 and {MAX_LISTED}")
    return live_runs(log).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def live_runs(log: DataFrame) -> DataFrame:
    """Runs that were saved and not deleted since, from the append-only run log. The numbers
    of the events decide, whatever their clocks say."""
    last = log.groupBy("run_id").agg(
        F.max_by("event", F.struct("event_no", "created_at")).alias("event"),
        F.max_by("created_at", F.struct("event_no", "created_at")).alias("created_at"),
    )
    return last.where("event = 'saved'").drop("event")

"""Projects, models, jobs and settings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_path

#: Job states that end a job.
ENDED = ("succeeded", "failed", "cancelled", "interrupted")


def latest_job(jobs: DataFrame, key: str, at: str, tie: str, limit: int = 1) -> DataFrame:
    """The last ``limit`` jobs of each project, newest first."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return jobs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def recent_jobs(jobs: DataFrame, key: str, state: str, at: str, tie: str, most: int = 50) -> DataFrame:
    """The jobs that a project shows, with ``nth``: those that run, newest first, then the last ``most`` that have ended."""
    ended = F.col(state).isin(*ENDED)
    newest = Window.partitionBy(key, "_ended").orderBy(F.desc(at), F.desc(tie))
    shown = jobs.withColumn("_ended", ended).withColumn("_n", F.row_number().over(newest)).where(~F.col("_ended") | (F.col("_n") <= most))
    return shown.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("_ended", "_n"))).drop("_ended", "_n")


def job_state(events: DataFrame, key: str, kind: str, at: str, tie: str) -> DataFrame:
    """The state of each job from its events: a cancel beats whatever ends it, an end beats progress. An event without a time counts as the last, as in SQL."""
    seen = lambda x: F.max(F.when(F.col(kind) == x, 1)).alias(x)
    flags = events.groupBy(key).agg(*[seen(x) for x in ("cancelled", "failed", "succeeded", "running")], F.max_by(kind, F.struct(F.col(at).isNull().alias("_a"), at, F.col(tie).isNull().alias("_t"), tie)).alias("last"))
    state = F.when(F.col("cancelled") == 1, "cancelled").when(F.col("failed") == 1, "failed").when(F.col("succeeded") == 1, "succeeded").when(F.col("running") == 1, "running").otherwise("queued")
    return flags.select(key, state.alias("state"), "last")


def interrupt(jobs: DataFrame) -> DataFrame:
    """At start no job runs: open ones are marked."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def resolve(projects: DataFrame, name_or_id: str) -> DataFrame:
    """By id, then by name."""
    number = int(name_or_id) if name_or_id.isdigit() else -1
    found = projects.where((F.col("id") == number) | (F.col("name") == name_or_id))
    return found.orderBy(F.desc(F.col("id") == number)).limit(1)


def by_path(projects: DataFrame, machine: str, path: str) -> DataFrame:
    """A project by its root on this machine (or on one that isn't named)."""
    same = normal_path(F.col("root_path")) == normal_path(F.lit(path))
    here = F.col("machine_id").isin(machine, "") if machine else F.lit(True)
    return projects.where(same & here).orderBy(F.desc(F.col("machine_id") == machine), "id").limit(1)


def with_active(models: DataFrame, settings: DataFrame) -> DataFrame:
    """Models with ``is_active``, from the setting ``active_model_id``."""
    chosen = settings.where("key = 'active_model_id'").agg(F.max(F.col("value").try_cast("long")).alias("_active"))
    return models.crossJoin(F.broadcast(chosen)).withColumn("is_active", F.col("id").eqNullSafe(F.col("_active"))).drop("_active")


def merge_models(curated: DataFrame, live: DataFrame, key: str = "name") -> DataFrame:
    """Curated models, then live ones of other names."""
    return curated.unionByName(live.join(curated.select(key), key, "left_anti").dropDuplicates([key]))


def is_embedding_model(name: Column) -> Column:
    return F.lower(name).rlike("embed|voyage|bge")


def insert_project(projects: DataFrame, row: dict) -> DataFrame:
    """A new project; its name must be free. Domains default to ``code``."""
    if not projects.where(F.col("name") == row["name"]).limit(1).isEmpty():
        raise ValueError(f"project {row['name']} exists")
    row = {"domains": "code"} | row
    return projects.unionByName(projects.sparkSession.createDataFrame([tuple(row.get(c) for c in projects.columns)], projects.schema))


def delete_project(projects: DataFrame, points: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Without the project and its points; an unknown name is an error."""
    if projects.where(F.col("name") == name).limit(1).isEmpty():
        raise KeyError(name)
    return projects.where(F.col("name") != name), points.where(F.col("project") != name)


def _row(table: DataFrame, row: dict) -> DataFrame:
    return table.sparkSession.createDataFrame([tuple(row.get(c) for c in table.columns)], table.schema)


def insert_model(models: DataFrame, row: dict) -> DataFrame:
    """A new model under the next free id."""
    last = models.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return models.unionByName(_row(models, row | {"id": last + 1}))


def update_model(models: DataFrame, row: dict) -> DataFrame:
    """The model of that id with the given values; an unknown id is an error."""
    if models.where(F.col("id") == row["id"]).limit(1).isEmpty():
        raise KeyError(row["id"])
    given = {c: v for c, v in row.items() if c in models.columns and c != "id"}
    kind = dict(models.dtypes)
    return models.select(*[F.when(F.col("id") == row["id"], F.lit(given[c]).cast(kind[c])).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in models.columns])


def set_active(models: DataFrame, settings: DataFrame, model: int) -> DataFrame:
    """The settings with this model active; it must exist."""
    if models.where(F.col("id") == model).limit(1).isEmpty():
        raise KeyError(model)
    return settings.where("key <> 'active_model_id'").unionByName(_row(settings, {"key": "active_model_id", "value": str(model)}))


def delete_model(models: DataFrame, settings: DataFrame, model: int) -> DataFrame:
    """Without the model; the active one can't be deleted, and an unknown id is an error."""
    found = with_active(models.where(F.col("id") == model), settings).select("is_active").first()
    if found is None:
        raise KeyError(model)
    if found[0]:
        raise ValueError(f"model {model} is active")
    return models.where(F.col("id") != model)


def key_identity(key: Column) -> Column:
    """The first eight characters of a key, for logs; short keys as a whole."""
    return F.left(key, F.lit(8))


def admitted(requests: DataFrame, keys: DataFrame, header: str = "authorization") -> DataFrame:
    """Requests whose bearer key is on the list (trimmed, empty ones don't count), with ``key_id``. Keys meet by digest only."""
    bearer = F.regexp_extract(F.col(header), r"^Bearer\s+(\S+)\s*$", 1)
    known = keys.select(F.trim("key").alias("_key")).where("_key <> ''").select(F.sha2("_key", 256).alias("_digest")).distinct()
    return requests.withColumns({"_digest": F.sha2(bearer, 256), "key_id": key_identity(bearer)}).join(known, "_digest").drop("_digest")

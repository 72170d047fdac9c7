"""Service snapshots: JSON documents of jobs, checkpoints, exceptions and metrics.

Each reader takes a DataFrame with a ``value`` column of JSON text, plus a key
column where a document describes one thing, and returns typed rows. Documents
are parsed in the task that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.rules import Rules

_JOBS = (
    "jobs array<struct<jid: string, name: string, state: string, `start-time`: bigint, "
    "duration: bigint, tasks: map<string, bigint>>>"
)
_CHECKPOINTS = (
    "counts struct<completed: bigint, failed: bigint, in_progress: bigint, restored: bigint, total: bigint>, "
    "latest struct<completed: struct<id: bigint, duration: bigint, state_size: bigint, trigger_timestamp: bigint>, "
    "failed: struct<id: bigint, failure_timestamp: bigint, failure_message: string>>, "
    "summary struct<state_size: struct<min: bigint, max: bigint, avg: bigint>>"
)
_EXCEPTIONS = (
    "`root-exception` string, `timestamp` bigint, "
    "`all-exceptions` array<struct<exception: string, task: string, location: string, `timestamp`: bigint>>"
)
_METRICS = (
    "status string, error string, data struct<resultType: string, result: "
    "array<struct<metric: map<string, string>, value: array<string>, `values`: array<array<string>>>>>"
)

_UNKNOWN_ERROR = "Unknown Prometheus error"


def _any_set(struct: str, fields: list[str]) -> Column:
    """The object is there and is not empty."""
    present = F.lit(False)
    for f in fields:
        present = present | F.col(f"{struct}.{f}").isNotNull()
    return present


def _first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


_BAD = "_bad"
#: Document kinds and their schemas.
DOCUMENTS = {"jobs": _JOBS, "checkpoints": _CHECKPOINTS, "exceptions": _EXCEPTIONS}


def _parsed(kind: str) -> Column:
    """The document of a value, in an array: a generator that reads it parses it once."""
    options = {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"}
    return F.array(F.from_json("value", f"{DOCUMENTS[kind]}, {_BAD} string", options))


def _is_sound(d: Column) -> Column:
    return d.isNotNull() & d[_BAD].isNull()


def _sound(snapshots: DataFrame, kind: str, *keep: str) -> DataFrame:
    """(keep..., d) of the documents that parse."""
    return snapshots.select(*keep, F.explode(F.filter(_parsed(kind), _is_sound)).alias("d"))


def snapshot_errors(snapshots: DataFrame, kind: str, key: str | None = None) -> DataFrame:
    """(kind, key, error, value) of the documents that the readers below leave out.

    A document that is missing, no JSON, or of other types than its kind is
    never read as an empty one: it is listed here instead, whole.
    """
    keep = [key] if key else []
    bad = snapshots.select(*keep, "value", F.explode(F.filter(_parsed(kind), lambda d: ~_is_sound(d))).alias("d"))
    return bad.select(
        F.lit(kind).alias("kind"),
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.when(F.col("value").isNull(), "missing").otherwise("malformed").alias("error"),
        "value",
    )


def job_overview(snapshots: DataFrame) -> DataFrame:
    """Jobs of the documents that parse; see ``snapshot_errors`` for the others."""
    job = F.inline("d.jobs")
    return _sound(snapshots, "jobs").select(job).select(
        F.col("jid").alias("job_id"),
        "name",
        "state",
        F.col("start-time").alias("start_time"),
        F.col("duration").alias("duration_ms"),
        F.coalesce("tasks", F.create_map().cast("map<string,bigint>")).alias("tasks"),
    )


def checkpoint_stats(snapshots: DataFrame) -> DataFrame:
    """Counters default to 0; the other blocks are null where the document has none.

    A document that does not parse has no row; see ``snapshot_errors``.
    """
    doc = _sound(snapshots, "checkpoints", "job_id")

    def block(struct: str, fields: dict[str, str]) -> Column:
        body = F.struct(*[F.col(f"{struct}.{f}").alias(name) for f, name in fields.items()])
        return F.when(_any_set(struct, list(fields)), body)

    counts = ["completed", "failed", "in_progress", "restored", "total"]
    return doc.select(
        "job_id",
        *[F.coalesce(F.col(f"d.counts.{c}"), F.lit(0)).alias(c) for c in counts],
        block(
            "d.latest.completed",
            {
                "id": "id",
                "duration": "duration_ms",
                "state_size": "size_bytes",
                "trigger_timestamp": "trigger_timestamp",
            },
        ).alias("latest_completed"),
        block(
            "d.latest.failed",
            {"id": "id", "failure_timestamp": "failure_timestamp", "failure_message": "failure_message"},
        ).alias("latest_failed"),
        block("d.summary.state_size", {"min": "min", "max": "max", "avg": "avg"}).alias("size_summary"),
    )


def job_exceptions(snapshots: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The exceptions of each job in given order; a job without any keeps one row.

    ``rules.max_exceptions`` keeps only the first ones. A document that does not
    parse has no row; see ``snapshot_errors``.
    """
    doc = _sound(snapshots, "exceptions", "job_id")
    first = _first(F.coalesce(F.col("d.all-exceptions"), F.array()), rules.max_exceptions)
    return doc.select(
        "job_id",
        F.col("d.root-exception").alias("root_exception"),
        F.col("d.timestamp").alias("root_timestamp"),
        F.posexplode_outer(first).alias("pos", "e"),
    ).select(
        "job_id",
        "root_exception",
        "root_timestamp",
        "pos",
        F.col("e.exception").alias("exception"),
        F.col("e.task").alias("task"),
        F.col("e.location").alias("location"),
        F.col("e.timestamp").alias("timestamp"),
    )


def metric_results(snapshots: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Points of successful metric results, one row per (series, point).

    ``result_count`` counts all series of a result; ``rules.metric_max_series``
    keeps only the first ones. A result without series keeps one row. ``value``
    stays text; ``number`` is its double.
    """
    doc = snapshots.select("query", F.from_json("value", _METRICS).alias("d")).filter(
        F.col("d.status") == "success"
    )
    result = F.coalesce(F.col("d.data.result"), F.array())
    kind = F.col("result_type")
    points = F.when(kind == "matrix", F.coalesce(F.col("s.values"), F.array())).when(
        kind == "vector", F.array(F.coalesce(F.col("s.value"), F.array()))
    )
    series = doc.select(
        "query",
        F.col("d.data.resultType").alias("result_type"),
        F.size(result).alias("result_count"),
        F.posexplode_outer(_first(result, rules.metric_max_series)).alias("series", "s"),
    )
    return series.select(
        "query",
        "result_type",
        "result_count",
        "series",
        F.coalesce(F.col("s.metric"), F.create_map().cast("map<string,string>")).alias("labels"),
        F.explode_outer(points).alias("p"),
    ).select(
        "query",
        "result_type",
        "result_count",
        "series",
        "labels",
        F.get("p", F.lit(0)).try_cast("double").alias("timestamp"),
        F.get("p", F.lit(1)).alias("value"),
        F.get("p", F.lit(1)).try_cast("double").alias("number"),
    )


def metric_errors(snapshots: DataFrame) -> DataFrame:
    """(query, error) of the results that did not succeed, unreadable ones included."""
    doc = snapshots.select("query", F.from_json("value", _METRICS).alias("d"))
    failed = F.coalesce(F.col("d.status") != "success", F.lit(True))
    return doc.filter(failed).select(
        "query", F.coalesce(F.col("d.error"), F.lit(_UNKNOWN_ERROR)).alias("error")
    )

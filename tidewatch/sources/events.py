"""Event sources, decoding and alert sinks.

The Kafka connector is a separate jar, which the option builders need on the
class path; the transforms behind them take any DataFrame, so files serve just
as well. Binary messages are decoded by ``tidewatch.sources.wire``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.keys import severity_ordinal
from tidewatch.schema import EVENT
from tidewatch.sources.wire import NAMED, decode_wire


def kafka_source_options(
    bootstrap: str, topic: str = "stream-events", group: str | None = None, **extra: str
) -> dict[str, str]:
    """Options of a Kafka source that starts at the latest offsets."""
    options = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": "latest",
        "failOnDataLoss": "true",
    }
    if group:
        options["kafka.group.id"] = group
    return options | extra


def kafka_sink_options(bootstrap: str, topic: str = "stream-alerts", **extra: str) -> dict[str, str]:
    """Options of the alert sink; Spark's Kafka sink delivers at least once."""
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic, "kafka.acks": "all"} | extra


def read_kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def read_event_files(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """EVENT records from parquet files, as a batch or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(_log_schema()).options(**options).parquet(path)


def _log_schema() -> T.StructType:
    out = T.StructType(list(EVENT.fields))
    return out.add("partition", T.IntegerType()).add("offset", T.LongType())


_BAD = "_bad"


def _lenient(kind: T.DataType) -> T.DataType:
    """Whole numbers as text: JSON may hold them as numbers, as quoted numbers, or as names of enum values."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _lenient(f.dataType)) for f in kind.fields])
    return T.StringType() if isinstance(kind, (T.LongType, T.IntegerType)) else kind


def _json_record(value: Column) -> Column:
    """Record of JSON text with the text itself in ``_bad`` where it is malformed."""
    wide = _lenient(EVENT).add(_BAD, T.StringType())
    # Empty bytes are a valid message without any field.
    text = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.when(value.isNotNull(), F.lit("{}")))
    return F.from_json(text, wide, {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})


def _number(kind: str | None, name: str, given: Column) -> Column:
    """Whole number of a text, or the number of an enum name."""
    number = given.try_cast("long")
    return F.coalesce(number, severity_ordinal(F.upper(given)).cast("long")) if (kind, name) == ("log", "severity") else number


def _name(kind: str, name: str, given: Column) -> Column:
    """Name of an enum value that is given by name or number; a number without a name stays as it is."""
    table = F.create_map(*[F.lit(x) for i, n in enumerate(NAMED[kind, name]) for x in (str(i), n)])
    return F.coalesce(F.try_element_at(table, given), given, F.lit(NAMED[kind, name][0]))


def _typed(e: str) -> Column:
    """EVENT struct of a JSON record. Scalars that are not set read as '' and 0, maps as empty, as the wire format has it."""

    def field(f: T.StructField, kind: str | None = None) -> Column:
        given = F.col(f"{e}.{kind}.{f.name}" if kind else f"{e}.{f.name}")
        if (kind, f.name) in NAMED:
            out = _name(kind, f.name, given)
        elif isinstance(f.dataType, T.MapType):
            out = F.coalesce(given, F.create_map().cast(f.dataType))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            out = F.coalesce(_number(kind, f.name, given), F.lit(0)).cast(f.dataType)
        else:
            out = F.coalesce(given, F.lit("").cast(f.dataType) if isinstance(f.dataType, T.StringType) else F.lit(0.0))
        return out.alias(f.name)

    def payload(f: T.StructField) -> Column:
        inner = F.struct(*[field(g, f.name) for g in f.dataType.fields])
        return F.when(F.col(f"{e}.{f.name}").isNotNull(), inner).alias(f.name)

    return F.struct(*[payload(f) if isinstance(f.dataType, T.StructType) else field(f) for f in EVENT.fields])


def _sound(e: str) -> Column:
    """The JSON parsed, and what should be a whole number is one."""
    ok = F.col(e).isNotNull() & F.col(f"{e}.{_BAD}").isNull()
    for f in EVENT.fields:
        kind = f.name if isinstance(f.dataType, T.StructType) else None
        for g in f.dataType.fields if kind else [f]:
            if isinstance(g.dataType, (T.LongType, T.IntegerType)):
                given = F.col(f"{e}.{kind}.{g.name}" if kind else f"{e}.{g.name}")
                ok = ok & (given.isNull() | _number(kind, g.name, given).isNotNull())
    return ok


def decode(records: DataFrame, protobuf: bool = False, fallback: bool = False) -> DataFrame:
    """Decode ``value``; a record that does not decode gets a null ``event`` and stays.

    The records are JSON or, with ``protobuf``, binary messages; ``fallback``
    then tries JSON on what is not such a message. Either way events have the
    same schema and the same defaults. Each step below is a projection of its
    own, so that a message is parsed once.
    """
    keep = [c for c in ("partition", "offset", "timestamp") if c in records.columns]
    parsed = records.select(*keep, "value")
    candidates = []
    if protobuf:
        parsed = decode_wire(parsed, event="_p")
        candidates.append(F.col("_p"))
    if not protobuf or fallback:
        text = F.when(F.col("_p").isNull(), F.col("value")) if protobuf else F.col("value")
        parsed = parsed.withColumn("_j", _json_record(text))
        candidates.append(F.when(_sound("_j"), _typed("_j")))
    return parsed.select(*keep, F.coalesce(*candidates).alias("event"))


def messages(decoded: DataFrame) -> DataFrame:
    """EVENT records of all messages of a log, those that did not decode as records without any payload.

    Their time is the message's own; a search scans them without finding anything.
    """
    own = [F.col(f"event.{f.name}").alias(f.name) for f in EVENT.fields if f.name != "timestamp_ms"]
    broker = [F.unix_millis("timestamp")] if "timestamp" in decoded.columns else []
    return decoded.select(F.coalesce(*broker, "event.timestamp_ms").alias("timestamp_ms"), *own, "partition", "offset")


def decoded_events(decoded: DataFrame, observation="decode") -> DataFrame:
    """The events that decoded, while counting those that did not.

    The count is reported as the observed metric ``errors``: in the progress of
    a stream, or through an ``Observation`` in a batch.
    """
    counted = decoded.observe(
        observation,
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col("event").isNull().cast("long")), F.lit(0)).alias("errors"),
    )
    keep = [c for c in ("partition", "offset") if c in decoded.columns]
    return counted.filter(F.col("event").isNotNull()).select("event.*", *keep)


def with_event_time(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Add ``event_time``; with a watermark only for operators that close windows."""
    out = events.withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    return out.withWatermark("event_time", watermark) if watermark else out

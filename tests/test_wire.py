"""Binary messages against a decoder that reads one field after the other."""

import random
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schema import EVENT
from tidewatch.sources import events as ev
from tidewatch.sources import wire


def varint(data, at):
    n = 0
    for i in range(10):
        if at >= len(data):
            raise ValueError("cut off")
        n |= (data[at] & 0x7F) << (7 * i)
        at += 1
        if data[at - 1] < 0x80:
            return n & (2**64 - 1), at
    raise ValueError("too long")


def read(data):
    """(number, wire type, value) of the fields of one message, groups left out."""
    at, depth, out = 0, 0, []
    while at < len(data):
        tag, at = varint(data, at)
        number, kind = tag >> 3, tag & 7
        if not 0 < number < 1 << 29 or kind > 5:
            raise ValueError("tag")
        value = None
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            depth += 1 if kind == 3 else -1
        if at > len(data) or depth < 0:
            raise ValueError("cut off")
        if depth == 0 and kind != 4:
            out.append((number, kind, value))
    if depth:
        raise ValueError("open group")
    return out


def signed(n, bits=64):
    n &= 2**bits - 1
    return n - 2**bits if n >> (bits - 1) else n


def payload(kind, parts):
    fields = {name: number for number, name in wire.PAYLOADS[kind].items()}
    found = [f for part in parts for f in read(part)]
    out = {}
    for f in EVENT[kind].dataType.fields:
        mine = [v for n, w, v in found if n == fields[f.name] and w == {"string": 2, "double": 1, "bigint": 0, "int": 0}.get(f.dataType.simpleString(), 2)]
        name = f.dataType.simpleString()
        if (kind, f.name) in wire.NAMED:
            numbers = [v for n, w, v in found if n == fields[f.name] and w == 0]
            number = signed(numbers[-1], 32) if numbers else 0
            names = wire.NAMED[kind, f.name]
            out[f.name] = names[number] if 0 <= number < len(names) else str(number)
        elif name.startswith("map"):
            out[f.name] = {}
            for entry in mine:
                pair = {1: "", 2: ""}
                for n, w, v in read(entry):
                    if w == 2 and n in pair:
                        pair[n] = v.decode()
                out[f.name][pair[1]] = pair[2]
        elif name == "string":
            out[f.name] = [v.decode() for v in mine][-1] if mine else ""
        elif name == "double":
            out[f.name] = struct.unpack("<d", mine[-1])[0] if mine else 0.0
        else:
            out[f.name] = signed(mine[-1], 32 if name == "int" else 64) if mine else 0
    return out


def model(data):
    if data is None:
        return None
    try:
        top = read(data)
        out = {"event_id": "", "timestamp_ms": 0, "source": ""} | dict.fromkeys(wire.PAYLOADS)
        chosen, parts = None, []
        for number, kind, value in top:
            name = wire.ENVELOPE.get(number)
            if name in ("event_id", "source") and kind == 2:
                out[name] = value.decode()
            elif name == "timestamp_ms" and kind == 0:
                out[name] = signed(value)
            elif name in wire.PAYLOADS and kind == 2:
                payload(name, [value])
                parts = [*parts, value] if name == chosen else [value]
                chosen = name
        if chosen:
            out[chosen] = payload(chosen, parts)
        return out
    except (ValueError, UnicodeDecodeError):
        return None


def decoded(values):
    out = []
    for r in wire.decode_batch(pa.array(values, pa.binary())).to_pylist():
        for kind in wire.PAYLOADS:
            for name in ("tags", "context", "labels", "metadata"):
                if r and r[kind] and name in r[kind]:
                    r[kind][name] = dict(r[kind][name])
        out.append(r)
    return out


def same(a, b):
    return repr(a) == repr(b)  # NaN equals NaN


EVENTS = [
    {"event_id": "e1", "timestamp_ms": 1718712000000, "source": "é", "metric": {"metric_name": "latency_ms", "value": 42.5, "unit": "ms", "component": "c", "tags": {"a": "b", "": "x"}}},
    {"event_id": "", "timestamp_ms": -5, "source": "", "log": {"severity": 4, "message": "m" * 300, "component": "", "logger_name": "l", "stack_trace": "", "context": {}}},
    {"event_id": "e3", "timestamp_ms": 0, "source": "s", "alert": {"alert_id": "a", "severity": "CRITICAL", "threshold": -1e300, "actual_value": float("nan"), "window_start_ms": 2**62, "window_end_ms": -1, "labels": {"k": "v"}}},
    {"event_id": "e4", "heartbeat": {"component": "c", "status": "7", "uptime_ms": 3, "metadata": {"x": "1", "y": ""}}},
    {"event_id": "e5", "log": {}},
]


def test_what_is_written_is_read():
    for event, back in zip(EVENTS, decoded([wire.encode_event(e) for e in EVENTS]), strict=True):
        assert same(back, model(wire.encode_event(event)))
        for kind in wire.PAYLOADS:
            assert (back[kind] is None) == (event.get(kind) is None)
            for name, value in (event.get(kind) or {}).items():
                assert same(back[kind][name], value)


A, B, C = (wire.encode_event(e) for e in EVENTS[:3])


@pytest.mark.parametrize(
    "data",
    [
        None, b"", b"this is not protobuf", b"\x00", b"\x08", A[:-1], A[: len(A) // 2], A + b"\xf8\x01\x01", A + b"\xff" * 11, A + B, B + A, A + A, B + C + B,
        wire._put(2, "text where a number belongs"), wire._put(1, 5), b"\x0a\x02\xff\xfe", b"\x0a\x01a\x0a\x01b", b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01",
        b"\x7b\x08\x01\x7c", b"\x7b\x08\x01", b"\x7c", b"\x0e", b"\x0f\x01", b"\x05\x01\x02\x03\x04", b"\x1d\x01\x02\x03\x04", b"\x1d\x01\x02", b"\x09" + b"\x01" * 7,
        wire._put_bytes(10, b"\x0a\x05ab"), wire._put_bytes(10, wire._put_bytes(5, b"\x0a\x05ab")) + B, wire._put_bytes(10, wire._put_bytes(5, b"\x0a\x01\xff")), b'{"event_id":"x"}', b"{}",
        wire._put_bytes(10, wire._put_bytes(5, b"\x0a\x01k\x12\x01a") + wire._put_bytes(5, b"") + wire._put_bytes(5, b"\x0a\x01k\x12\x01b")),
        wire._put_bytes(10, wire._put(1, "x")) + wire._put_bytes(10, wire._put(3, "y")),
    ],
)
def test_odd_messages(data):
    # Alone, and between others, in a slice of a larger array.
    assert same(decoded([data]), [model(data)])
    values = pa.array([b"skipped", A, data, None, B], pa.binary()).slice(1)
    assert same(decoded(values.to_pylist())[1], model(data))
    assert same([r and r["event_id"] for r in wire.decode_batch(values).to_pylist()][::3], ["e1", ""])


PIECES = [A, B, C, A[:9], b"\x0a", b"\x12\x03abc", b"\x10\x96\x01", b"\x52", b"\x00", b"\x7b", b"\x7c", b"\x80", wire._put_bytes(11, wire._put(1, 9)), wire._put_bytes(13, wire._put(2, 2))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=24), st.lists(st.sampled_from(PIECES), max_size=6).map(b"".join), st.none()), max_size=12))
def test_equals_the_model(values):
    assert same(decoded(values), [model(v) for v in values])


def test_many_entries_and_long_messages():
    event = {"event_id": "x" * 100_000, "metric": {"tags": {str(i): "v" * (i % 7) for i in range(3000)}}}
    assert decoded([wire.encode_event(event)])[0]["metric"]["tags"] == event["metric"]["tags"]


def frame(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "partition int, offset long, value binary").repartition(3)


def test_both_formats_give_one_schema_and_the_same_rows(spark):
    rng = random.Random(1)
    rows = [EVENTS[i] | {"event_id": f"e{rng.random()}"} for i in (0, 1, 2, 3, 4) for _ in range(5)]
    wired = ev.decode(frame(spark, [wire.encode_event(e) for e in rows]), protobuf=True)
    import json

    texts = [json.dumps(e).replace("NaN", "null").encode() for e in rows]
    parsed = ev.decode(frame(spark, texts))
    assert wired.schema.simpleString() == parsed.schema.simpleString()
    one = {r.offset: r.event.asDict(True) for r in wired.collect()}
    two = {r.offset: r.event.asDict(True) for r in parsed.collect()}
    for i, e in enumerate(rows):
        if "alert" in e:
            one[i]["alert"]["actual_value"] = two[i]["alert"]["actual_value"] = None
        assert one[i] == two[i]


def test_bad_records_stay_and_are_counted(spark):
    values = [A, b"this is not protobuf", None, b"", A[:-1], b'{"event_id":"j"}']
    out = {r.offset: r.event for r in ev.decode(frame(spark, values), protobuf=True).collect()}
    assert [out[i] is not None for i in range(6)] == [True, False, False, True, False, False]
    assert out[3].event_id == "" and out[3].metric is None
    both = {r.offset: r.event for r in ev.decode(frame(spark, values), protobuf=True, fallback=True).collect()}
    assert [both[i] is not None for i in range(6)] == [True, False, False, True, False, True]
    assert both[5].event_id == "j"


def test_json_takes_names_and_numbers(spark):
    texts = [
        b'{"timestamp_ms":"12","log":{"severity":"ERROR"}}', b'{"timestamp_ms":12,"log":{"severity":4}}', b'{"log":{"severity":"LOUD"}}', b'{"timestamp_ms":"x"}',
        b'{"alert":{"severity":2}}', b'{"alert":{"severity":"PAGE"}}', b'{"heartbeat":{"status":1,"uptime_ms":"7"}}', b'{"heartbeat":{"status":99}}',
    ]
    out = {r.offset: r.event for r in ev.decode(frame(spark, texts)).collect()}
    assert (out[0].timestamp_ms, out[0].log.severity) == (12, 4) == (out[1].timestamp_ms, out[1].log.severity)
    assert out[2] is None and out[3] is None
    assert (out[4].alert.severity, out[5].alert.severity) == ("CRITICAL", "PAGE")
    assert (out[6].heartbeat.status, out[6].heartbeat.uptime_ms, out[7].heartbeat.status) == ("HEALTHY", 7, "99")


def test_messages_keep_what_does_not_decode(spark):
    values = frame(spark, [A, b"nope"]).withColumn("timestamp", F.timestamp_millis(F.lit(77) + F.col("offset")))
    out = {r.offset: r for r in ev.messages(ev.decode(values, protobuf=True)).collect()}
    assert (out[0].timestamp_ms, out[0].event_id, out[1].timestamp_ms, out[1].log) == (77, "e1", 78, None)


def test_encoding_of_a_table(spark):
    rows = [(e.get("event_id", ""), e.get("timestamp_ms", 0), e.get("source", "")) for e in EVENTS]
    df = spark.createDataFrame(rows, "event_id string, timestamp_ms long, source string")
    for kind in wire.PAYLOADS:
        df = df.withColumn(kind, F.lit(None).cast(EVENT[kind].dataType))
    got = [r.value for r in wire.encode_wire(df, ["event_id"]).collect()]
    assert [model(bytes(v))["event_id"] for v in got] == [r[0] for r in rows]
    assert wire.encode_wire(df.limit(0)).collect() == []


def test_batches_are_written_like_single_records():
    rng = random.Random(4)
    kinds = {
        T.StringType: lambda: rng.choice([None, "", "a", "é" * 70, "x" * 300]), T.LongType: lambda: rng.choice([None, 0, 1, 127, 128, -1, 2**63 - 1, -(2**63)]),
        T.IntegerType: lambda: rng.choice([None, 0, 3, -2, 2**31 - 1]), T.DoubleType: lambda: rng.choice([None, 0.0, -0.0, 1.5, float('inf'), float('nan')]),
        T.MapType: lambda: rng.choice([None, {}, {"": ""}, {"k": None, "l" * 200: "v"}]),
    }

    def payload(kind):
        named = {f: rng.choice([None, *wire.NAMED[k, f], "17"]) for k, f in wire.NAMED if k == kind}
        return {f.name: kinds[type(f.dataType)]() for f in EVENT[kind].dataType.fields} | named

    rows = []
    for _ in range(300):
        row = {f.name: kinds[type(f.dataType)]() for f in EVENT.fields if f.name not in wire.PAYLOADS}
        rows.append(row | {kind: payload(kind) if rng.random() < 0.4 else None for kind in wire.PAYLOADS})
    schema = pa.schema([(f.name, wire._arrow(f.dataType)) for f in EVENT.fields])
    batch = pa.RecordBatch.from_pylist([r | {k: v | {f: list(m.items()) for f, m in v.items() if isinstance(m, dict)} for k, v in r.items() if isinstance(v, dict)} for r in rows], schema)
    for part, records in ((batch, rows), (batch.slice(7, 100), rows[7:107]), (batch.slice(0, 0), [])):
        assert wire.encode_batch(part).to_pylist() == [wire.encode_event(r) for r in records]


def test_writing_a_batch_holds_no_record_as_an_object():
    import tracemalloc

    schema = pa.schema([(f.name, wire._arrow(f.dataType)) for f in EVENT.fields])
    metric = {"metric_name": "m", "value": 1.5, "unit": "ms", "component": "c", "tags": [("k", "v")]}
    batch = pa.RecordBatch.from_pylist([{"event_id": str(i), "timestamp_ms": i, "source": "s", "metric": metric} for i in range(10_000)], schema)
    tracemalloc.start()
    try:
        encoded = wire.encode_batch(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(encoded) == 10_000 and peak < 6 << 20


def test_memory_does_not_grow_with_the_length_of_messages():
    import tracemalloc

    log = {"severity": 2, "message": "é" * 4000, "component": "c", "context": [("k", "v" * 500)]}
    values = [wire.encode_event({"event_id": str(i), "source": "s", "log": log}) if i % 7 else [None, b"", b"\x0a\x05"][i % 3] for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(values, pa.binary())], names=["n", "value"])
    numbers, wrong = [], 0
    tracemalloc.start()
    try:
        for part in wire._decoded(iter([batch]), "value", "event"):
            numbers += part.column("n").to_pylist()
            wrong += sum(e != f for e, f in zip(part.column("event").is_valid().to_pylist(), [v not in (None, b"\x0a\x05") for v in part.column("value").to_pylist()], strict=True))
            assert {len(x) for x in part.column("event").field("log").field("message").drop_null().to_pylist()} <= {0, 4000}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (numbers, wrong) == (list(range(5000)), 0) and batch.nbytes > 30 << 20
    assert peak < 20 * wire.PART_BYTES, peak


def test_parts_of_a_batch_decode_like_the_whole(monkeypatch):
    values = pa.array([wire.encode_event(e) for e in EVENTS] + [None, b"", b"nope"], pa.binary())
    batch = pa.RecordBatch.from_arrays([values], names=["value"])
    whole = list(map(str, wire.decode_batch(values).to_pylist()))  # as text: one value is not a number
    monkeypatch.setattr(wire, "PART_BYTES", 64)
    parts = list(wire._decoded(iter([batch, batch.slice(0, 0)]), "value", "event"))
    assert [str(e) for part in parts for e in part.column("event").to_pylist()] == whole
    assert len(parts) > 3 and list(map(str, wire.decode_batch(values.slice(2, 3)).to_pylist())) == whole[2:5]

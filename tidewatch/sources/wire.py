"""Events in the protobuf wire format, read and written without a generated class or a jar.

A batch of messages is decoded in step: every message has a cursor, and each round reads one field of all messages that
are not at their end yet. Nested messages and map entries go through the same rounds, so the work per batch is a number
of array operations that depends on the fields of a message, not on the number of messages. Writing goes column by column.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.schema import EVENT

# Field numbers of the messages, and the names of their enum values.
ENVELOPE = {1: "event_id", 2: "timestamp_ms", 3: "source", 10: "metric", 11: "log", 12: "alert", 13: "heartbeat"}
PAYLOADS = {
    "metric": {1: "metric_name", 2: "value", 3: "unit", 4: "component", 5: "tags"},
    "log": {1: "severity", 2: "message", 3: "component", 4: "logger_name", 5: "stack_trace", 6: "context"},
    "alert": {
        1: "alert_id", 2: "severity", 3: "rule_name", 4: "description", 5: "component", 6: "threshold",
        7: "actual_value", 8: "window_start_ms", 9: "window_end_ms", 10: "labels",
    },
    "heartbeat": {1: "component", 2: "status", 3: "uptime_ms", 4: "metadata"},
}
ALERT_SEVERITIES = ["ALERT_SEVERITY_UNSPECIFIED", "WARNING", "CRITICAL", "PAGE"]
STATUSES = ["COMPONENT_STATUS_UNSPECIFIED", "HEALTHY", "DEGRADED", "UNHEALTHY"]
#: Enum fields that EVENT holds by name.
NAMED = {("alert", "severity"): ALERT_SEVERITIES, ("heartbeat", "status"): STATUSES}

_VARINT, _FIXED64, _BYTES, _START, _END, _FIXED32 = 0, 1, 2, 3, 4, 5
#: Bytes of messages or events that are worked on together: what a worker holds does not grow with their length.
PART_BYTES = 8 << 20
_ENTRY = pa.map_(pa.string(), pa.string())


@dataclass
class Fields:
    """Fields of many messages, in the order of their rounds; owner is the message."""

    owner: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    """Varints and fixed numbers, as unsigned bits."""
    start: np.ndarray
    end: np.ndarray

    def where(self, mask: np.ndarray) -> Fields:
        return Fields(*(getattr(self, f)[mask] for f in self.__dataclass_fields__))


def _varint(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, place after it, sound) of the varints that start at ``at``."""
    value, place = np.zeros(len(at), np.uint64), at.copy()
    open_, sound = np.ones(len(at), bool), np.ones(len(at), bool)
    for i in range(10):
        sound &= ~(open_ & (place >= end))
        open_ &= sound
        if not open_.any():
            break
        byte = data[np.where(open_, place, 0)].astype(np.uint64)
        value = np.where(open_, value | ((byte & np.uint64(0x7F)) << np.uint64(7 * i)), value)
        place = np.where(open_, place + 1, place)
        open_ &= byte >= 0x80
    return value, place, sound & ~open_


def read_fields(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Fields, np.ndarray]:
    """All fields of the messages data[start:end], and which messages are malformed. Groups are skipped.

    ``data`` carries eight bytes more than the messages need.
    """
    rounds: list[Fields] = []
    bad = np.zeros(len(start), bool)
    depth = np.zeros(len(start), np.int64)
    owner, at = np.arange(len(start)), start.astype(np.int64)
    end = end.astype(np.int64)
    while True:
        left = (at < end[owner]) & ~bad[owner]
        owner, at = owner[left], at[left]
        if not len(owner):
            break
        stop = end[owner]
        tag, at, sound = _varint(data, at, stop)
        kind, number = (tag & np.uint64(7)).astype(np.int64), (tag >> np.uint64(3)).astype(np.int64)
        sound &= (number > 0) & (number < 1 << 29) & (kind <= _FIXED32)
        value, after, whole = _varint(data, at, stop)
        counted = (kind == _VARINT) | (kind == _BYTES)
        sound &= whole | ~counted
        size = np.where(kind == _FIXED64, 8, np.where(kind == _FIXED32, 4, 0))
        # A length beyond the message is malformed; compared as unsigned, so that it can't wrap around.
        long_ = (kind == _BYTES) & (value > (stop - np.minimum(after, stop)).astype(np.uint64))
        sound &= ~long_
        begin = np.where(counted, after, at)
        until = begin + np.where((kind == _BYTES) & sound, value, 0).astype(np.int64) + size
        sound &= until <= stop
        depth[owner] += (kind == _START).astype(np.int64) - (kind == _END)
        sound &= depth[owner] >= 0
        bad[owner] |= ~sound
        fixed = kind == _FIXED64
        if fixed.any():
            places = np.where(fixed & sound, begin, 0)[:, None] + np.arange(8)
            value = np.where(fixed, np.ascontiguousarray(data[places]).view("<u8")[:, 0], value)
        keep = sound & (depth[owner] == 0) & (kind != _END)
        rounds.append(Fields(owner, number, kind, value, begin, until).where(keep))
        at = np.where(sound, until, stop)
    bad |= depth > 0
    if not rounds:
        none = np.zeros(0, np.int64)
        return Fields(none, none, none, none.astype(np.uint64), none, none), bad
    joined = Fields(*(np.concatenate([getattr(r, f) for r in rounds]) for f in Fields.__dataclass_fields__))
    return joined.where(~bad[joined.owner]), bad


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary values data[start:end]."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat((start - offsets[:-1]).astype(np.int32), sizes)
    places += np.arange(offsets[-1], dtype=np.int32)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places].tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(start), buffers)


def _texts(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Binary values as texts, and which of them are not UTF-8 (those become empty)."""
    bad = np.zeros(len(values), bool)
    try:
        return values.cast(pa.string()), bad
    except pa.ArrowInvalid:
        out = []
        for i, value in enumerate(values.to_pylist()):
            try:
                out.append(value.decode())
            except UnicodeDecodeError:
                bad[i] = True
                out.append("")
        return pa.array(out, pa.string()), bad


class _Message:
    """Columns of one kind of message, for a number of records; ``owner`` maps its parts to records."""

    def __init__(self, data: np.ndarray, fields: Fields, count: int, bad: np.ndarray):
        self.data, self.fields, self.count, self.bad = data, fields, count, bad

    def _last(self, owners: np.ndarray) -> np.ndarray:
        """Per record, the place of its last value, or -1."""
        out = np.full(self.count, -1, np.int64)
        out[owners] = np.arange(len(owners))
        return out

    def _numbers(self, number: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.fields.where((self.fields.number == number) & (self.fields.kind == kind))
        last = self._last(found.owner)
        bits = np.append(found.value, np.uint64(0))
        return bits[last], last

    def int64(self, number: int) -> pa.Array:
        return pa.array(self._numbers(number, _VARINT)[0].view(np.int64), pa.int64())

    def int32(self, number: int) -> pa.Array:
        return pa.array(self._numbers(number, _VARINT)[0].astype(np.uint32).view(np.int32), pa.int32())

    def double(self, number: int) -> pa.Array:
        return pa.array(self._numbers(number, _FIXED64)[0].view(np.float64), pa.float64())

    def name(self, number: int, names: list[str]) -> pa.Array:
        """Names of enum numbers; a number without one as its digits."""
        numbers = self.int32(number).to_numpy()
        known = pa.array(names).take(pa.array(np.clip(numbers, 0, len(names) - 1)))
        if ((numbers >= 0) & (numbers < len(names))).all():
            return known
        return pa.array([names[n] if 0 <= n < len(names) else str(n) for n in numbers.tolist()], pa.string())

    def text(self, number: int) -> pa.Array:
        found = self.fields.where((self.fields.number == number) & (self.fields.kind == _BYTES))
        values, wrong = _texts(_slices(self.data, found.start, found.end))
        self.bad[found.owner[wrong]] = True
        last = self._last(found.owner)
        padded = pa.concat_arrays([values, pa.array([""], pa.string())])
        return padded.take(pa.array(np.where(last < 0, len(values), last)))

    def map(self, number: int) -> pa.Array:
        """Entries in the order of their first appearance; the last value of a key counts."""
        found = self.fields.where((self.fields.number == number) & (self.fields.kind == _BYTES))
        order = np.argsort(found.owner, kind="stable")
        found = found.where(order)
        parts, wrong = read_fields(self.data, found.start, found.end)
        entries = _Message(self.data, parts, len(found.owner), wrong)
        keys, values = entries.text(1), entries.text(2)
        self.bad[found.owner[entries.bad]] = True
        codes = keys.dictionary_encode().indices.to_numpy()
        both = found.owner * (len(codes) + 1) + codes
        _, first, group = np.unique(both, return_index=True, return_inverse=True)
        latest = np.zeros(len(first), np.int64)
        latest[group] = np.arange(len(both))
        shown = np.argsort(first, kind="stable")
        owners = found.owner[first[shown]]
        offsets = np.searchsorted(owners, np.arange(self.count + 1))
        return pa.MapArray.from_arrays(
            pa.array(offsets, pa.int32()), keys.take(pa.array(first[shown])), values.take(pa.array(latest[shown]))
        )


def _payload(kind: str, message: _Message) -> list[pa.Array]:
    """The columns of EVENT's payload struct, in its order."""
    numbers = {name: number for number, name in PAYLOADS[kind].items()}
    out = []
    for f in EVENT[kind].dataType.fields:
        number = numbers[f.name]
        if (kind, f.name) in NAMED:
            out.append(message.name(number, NAMED[kind, f.name]))
        else:
            read: dict[type, Callable[[int], pa.Array]] = {
                T.StringType: message.text, T.DoubleType: message.double, T.LongType: message.int64,
                T.IntegerType: message.int32, T.MapType: message.map,
            }
            out.append(read[type(f.dataType)](number))
    return out


def decode_batch(values: pa.Array) -> pa.StructArray:
    """EVENT structs of binary messages; null where a message is null or malformed.

    Absent scalars are '' and 0, absent payloads null. Of several payloads the last kind counts, and parts of one
    payload are merged, as the format has it. Unknown fields, and fields of another wire type, are skipped.
    """
    values = values.cast(pa.binary())
    count = len(values)
    missing = values.is_null().to_numpy(zero_copy_only=False)
    plain = values.fill_null(b"")
    _, offsets, body = plain.buffers()
    places = np.frombuffer(offsets, np.int32)[plain.offset : plain.offset + count + 1].astype(np.int64)
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    # Of a slice of a batch, its own part only.
    data = np.concatenate([raw[places[0] : places[-1]], np.zeros(8, np.uint8)])
    places -= places[0]
    top, bad = read_fields(data, places[:-1], places[1:])
    envelope = _Message(data, top, count, bad)
    columns = [envelope.text(1), envelope.int64(2), envelope.text(3)]
    numbers = [n for n, name in ENVELOPE.items() if name in PAYLOADS]
    parts = top.where(np.isin(top.number, numbers) & (top.kind == _BYTES))
    # What is malformed in a part that another one replaces still spoils the message.
    inner, wrong = read_fields(data, parts.start, parts.end)
    bad[parts.owner[wrong]] = True
    last = np.full(count, -1, np.int64)
    last[parts.owner] = np.arange(len(parts.owner))
    chosen = np.append(parts.number, 0)[last]
    # The place of the last part of another kind: what stands before it is replaced.
    other = np.full(count, -1, np.int64)
    differs = parts.number != chosen[parts.owner]
    other[parts.owner[differs]] = np.flatnonzero(differs)
    counts = ~differs & (np.arange(len(parts.owner)) > other[parts.owner])
    # Replaced parts are read as records of their own behind the others, only for what may be malformed in them.
    replaced = np.flatnonzero(~counts)
    record = parts.owner.copy()
    record[replaced] = count + np.arange(len(replaced))
    all_bad = np.concatenate([bad, np.zeros(len(replaced), bool)])
    for number in numbers:
        kind = ENVELOPE[number]
        mine = inner.where((parts.number == number)[inner.owner])
        # Parts of one message are read one after the other, so later ones must stay behind earlier ones.
        fields = mine.where(np.argsort(mine.owner, kind="stable"))
        fields.owner = record[fields.owner]
        message = _Message(data, fields, count + len(replaced), all_bad)
        absent = pa.array(chosen != number)
        arrow = [pa.field(f.name, _arrow(f.dataType)) for f in EVENT[kind].dataType.fields]
        payload = [column.slice(0, count) for column in _payload(kind, message)]
        columns.append(pa.StructArray.from_arrays(payload, fields=arrow, mask=absent))
    bad |= all_bad[:count]
    bad[parts.owner[replaced[all_bad[count:]]]] = True
    arrow = [pa.field(f.name, _arrow(f.dataType)) for f in EVENT.fields]
    return pa.StructArray.from_arrays(columns, fields=arrow, mask=pa.array(missing | bad))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {T.StringType: pa.string(), T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.MapType: _ENTRY}[type(kind)]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, PART_BYTES at most at a time, but for single longer ones."""
    if batch.num_rows < 2 or batch.nbytes <= PART_BYTES:
        yield batch
    else:
        for start, end in ((0, batch.num_rows // 2), (batch.num_rows // 2, batch.num_rows)):
            yield from _parts(batch.slice(start, end - start))


def _decoded(batches: Iterator[pa.RecordBatch], value: str, event: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            yield pa.RecordBatch.from_arrays([*part.columns, decode_batch(part.column(value))], names=[*part.schema.names, event])


def decode_wire(records: DataFrame, value: str = "value", event: str = "event") -> DataFrame:
    """records with ``event``, the EVENT struct of the binary ``value``; null where it does not decode."""
    schema = T.StructType([*records.schema.fields, T.StructField(event, EVENT)])
    return records.mapInArrow(lambda it: _decoded(it, value, event), schema)


# Writing.


def _put_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _put_bytes(number: int, body: bytes) -> bytes:
    return _put_varint(number << 3 | _BYTES) + _put_varint(len(body)) + body


def _put(number: int, value, names: list[str] | None = None) -> bytes:
    """One field; empty and zero values are left out, as the format has it."""
    if names is not None and isinstance(value, str):
        value = names.index(value) if value in names else int(value)
    if not value:
        return b""
    if isinstance(value, str):
        return _put_bytes(number, value.encode())
    if isinstance(value, float):
        return _put_varint(number << 3 | _FIXED64) + struct.pack("<d", value)
    if isinstance(value, int):
        return _put_varint(number << 3) + _put_varint(value)
    entries = value.items() if isinstance(value, dict) else value
    return b"".join(_put_bytes(number, _put_bytes(1, k.encode()) + _put_bytes(2, (v or "").encode())) for k, v in entries)


def encode_event(event: dict) -> bytes:
    """The wire format of one EVENT record."""
    out = b"".join(_put(n, event.get(name)) for n, name in ENVELOPE.items() if name not in PAYLOADS)
    for number, kind in ENVELOPE.items():
        payload = event.get(kind) if kind in PAYLOADS else None
        if payload is not None:
            body = (_put(n, payload.get(name), NAMED.get((kind, name))) for n, name in PAYLOADS[kind].items())
            out += _put_bytes(number, b"".join(body))
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these sizes, one after the other in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of messages is beyond 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _varints(numbers: np.ndarray) -> pa.Array:
    shifted = numbers.astype(np.uint64)[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))
    sizes = np.maximum(1, np.count_nonzero(shifted, axis=1))
    at = np.arange(10)
    bytes_ = (shifted & np.uint64(0x7F)).astype(np.uint8) | np.where(at < sizes[:, None] - 1, 0x80, 0).astype(np.uint8)
    return _binary(bytes_[at < sizes[:, None]], sizes)


def _join(*parts: pa.Array | bytes) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts), pa.scalar(b"", pa.binary()))


def _sized(number: int, bodies: pa.Array) -> pa.Array:
    """Each body as a field with its length."""
    return _join(_put_varint(number << 3 | _BYTES), _varints(pc.binary_length(bodies).to_numpy(zero_copy_only=False)), bodies)


def _where(present: np.ndarray, fields: pa.Array) -> pa.Array:
    return pc.if_else(pa.array(present), fields, pa.scalar(b"", pa.binary()))


def _column(number: int, values: pa.Array, names: list[str] | None = None) -> pa.Array:
    """``_put`` of each value of a column."""
    if pa.types.is_map(values.type):
        texts = [t.cast(pa.binary()).fill_null(b"") for t in (values.keys, values.items)]
        entries = _sized(number, _join(_sized(1, texts[0]), _sized(2, texts[1])))
        _, ends, body = entries.buffers()
        places = np.frombuffer(ends, np.int32)[entries.offset : entries.offset + len(entries) + 1][values.offsets.to_numpy()]
        rows = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(places.astype(np.int32)), body])
        return _where(values.is_valid().to_numpy(zero_copy_only=False), rows)
    if names is not None:
        numbers = pc.index_in(values, pa.array(names)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in np.flatnonzero(numbers < 0).tolist():
            numbers[i] = int(values[i].as_py() or 0)
        values = pa.array(numbers)
    if pa.types.is_floating(values.type):
        numbers = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")
        fixed = _binary(numbers.view(np.uint8), np.full(len(numbers), 8))
        return _where(numbers != 0, _join(_put_varint(number << 3 | _FIXED64), fixed))
    if pa.types.is_integer(values.type):
        numbers = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return _where(numbers != 0, _join(_put_varint(number << 3), _varints(numbers.view(np.uint64))))
    texts = values.cast(pa.binary()).fill_null(b"")
    return _where(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, _sized(number, texts))


def encode_batch(events: pa.RecordBatch) -> pa.Array:
    """``encode_event`` of each row, column by column."""
    out = [_column(n, events.column(name)) for n, name in ENVELOPE.items() if name not in PAYLOADS]
    for number, kind in ENVELOPE.items():
        if kind in PAYLOADS and (payload := events.column(kind)).null_count < len(payload):
            given = dict(zip(payload.type.names, payload.flatten(), strict=True))
            body = _join(*(_column(n, given[name], NAMED.get((kind, name))) for n, name in PAYLOADS[kind].items() if name in given))
            out.append(_where(payload.is_valid().to_numpy(zero_copy_only=False), _sized(number, body)))
    return _join(*out)


def encode_wire(events: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(keep..., value): EVENT records as binary messages, for a producer or a test."""
    schema = T.StructType([events.schema[c] for c in keep] + [T.StructField("value", T.BinaryType())])
    columns = [f.name for f in EVENT.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                encoded = encode_batch(part.select(columns))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), encoded], names=[*keep, "value"])

    return events.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, schema)

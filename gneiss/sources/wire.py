"""The record formats' bytes: length-prefixed record files, and example and sequence-example records.

A record file is a run of: length (8 bytes, little endian), its masked CRC-32C, the record, its masked CRC-32C.
Records are messages of the public protocol buffer encoding.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The reflected CRC-32C polynomial and the mask that the file format adds.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


PIECE = 256


@lru_cache(maxsize=1)
def _shift() -> np.ndarray:
    """Four tables that move a CRC register over PIECE zero bytes, one for each of its bytes."""
    table = _table()
    crc = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    for _ in range(PIECE):
        crc = table[crc & 0xFF] ^ (crc >> 8)
    return crc


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record. All pieces of PIECE bytes of all records go through at once, a byte of each at a time.

    The register is linear in what went before: a record's first piece is filled up with zeros in front, which leave an
    empty register empty, and pieces are joined by moving the register over a piece. The start value flips the first
    four bytes; shorter records are filled up to these by the end of the computation.
    """
    table, shift = _table(), _shift()
    n = np.array([len(r) for r in records], np.int64)
    pieces = np.maximum(1, -(-n // PIECE))
    ends = np.cumsum(pieces) * PIECE
    buf = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for r, size, end in zip(records, n.tolist(), ends.tolist()):
        buf[end - size : end] = np.frombuffer(r, np.uint8)
    at = (ends - n)[:, None] + np.arange(4)
    some = np.arange(4) < n[:, None]
    buf[at[some]] ^= 0xFF
    part = np.zeros(len(buf) // PIECE, np.uint32)
    for column in np.ascontiguousarray(buf.reshape(-1, PIECE).T):
        part = table[(part ^ column) & 0xFF] ^ (part >> 8)
    first = np.cumsum(pieces) - pieces
    crc = np.zeros(len(n), np.uint32)
    for i in range(int(pieces.max()) if len(n) else 0):
        live = np.flatnonzero(pieces > i)
        c = crc[live]
        crc[live] = shift[0][c & 0xFF] ^ shift[1][c >> 8 & 0xFF] ^ shift[2][c >> 16 & 0xFF] ^ shift[3][c >> 24] ^ part[first[live] + i]
    # what the start value leaves of itself in records of less than four bytes
    left = np.where(n < 4, np.uint32(0xFFFFFFFF) >> (8 * np.minimum(n, 3)).astype(np.uint32), np.uint32(0))
    return crc ^ left ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK_DELTA)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frame(records: list[bytes]) -> bytes:
    """The file content of some records."""
    heads = [struct.pack("<Q", len(r)) for r in records]
    a, b = masked(crc32c(heads)), masked(crc32c(records))
    return b"".join(x for h, p, r, q in zip(heads, a.tolist(), records, b.tolist()) for x in (h, struct.pack("<I", p), r, struct.pack("<I", q)))


def unframe(data: bytes, verify: bool = True) -> list[bytes]:
    """The records of a file's content; what is cut off or damaged is an error."""
    out, at = _framed(data)
    if at < len(data):
        raise ValueError("a record file ends within a record")
    if verify:
        _verify(data, out)
    return [data[a:b] for a, b in out]


def _framed(data: bytes) -> tuple[list[tuple[int, int]], int]:
    """Where the whole records of data lie, and where the next one begins."""
    out, at, size = [], 0, len(data)
    while at + 12 <= size:
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > size:
            break
        out.append((at + 12, at + 12 + n))
        at += 16 + n
    return out, at


def _verify(data: bytes, places: list[tuple[int, int]]) -> None:
    if not places:
        return
    heads = masked(crc32c([data[a - 12 : a - 4] for a, _ in places]))
    bodies = masked(crc32c([data[a:b] for a, b in places]))
    want = np.array([(*struct.unpack_from("<I", data, a - 4), *struct.unpack_from("<I", data, b)) for a, b in places], np.uint32)
    if (heads != want[:, 0]).any() or (bodies != want[:, 1]).any():
        raise ValueError("a record file's checksum does not hold")


def stream_records(source, verify: bool = True, size: int = 4 << 20):
    """Lists of records of an open file, read `size` bytes at a time; a longer record is read on its own."""
    rest = b""
    while True:
        want = size
        if len(rest) >= 12:
            (n,) = struct.unpack_from("<Q", rest, 0)
            if verify and n > size:
                (head,) = struct.unpack_from("<I", rest, 8)
                if masked(crc32c([rest[:8]]))[0] != head:
                    raise ValueError("a record file's checksum does not hold")
            want = max(size, n + 16 - len(rest))
        more = source.read(want)
        if not more:
            break
        data = rest + more
        places, at = _framed(data)
        if verify:
            _verify(data, places)
        if places:
            yield [data[a:b] for a, b in places]
        rest = data[at:]
    if rest:
        raise ValueError("a record file ends within a record")


class ParseError(ValueError):
    pass


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        if i >= len(b) or s > 63:
            raise ParseError("Unable to parse example.")
        c = b[i]
        i += 1
        x |= (c & 0x7F) << s
        if c < 0x80:
            return x & 0xFFFFFFFFFFFFFFFF, i
        s += 7


def _fields(b: bytes):
    """(number, wire type, value) of a message's fields: an int, or the bytes of a delimited or fixed one."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ParseError("Unable to parse example.")
            if i + n > len(b):
                raise ParseError("Unable to parse example.")
            v = b[i : i + n]
            i += n
        yield tag >> 3, kind, v


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _feature(b: bytes):
    """(kind, values) of a feature; (None, None) if its kind is unset. The last kind set counts."""
    kind, values = None, None
    for number, wire, v in _fields(b):
        if wire != 2 or number not in (1, 2, 3):
            continue
        new = {1: "BYTES", 2: "FLOAT", 3: "INT"}[number]
        if new != kind:
            kind, values = new, []
        for n, w, x in _fields(v):
            if n != 1:
                continue
            if number == 1:
                values.append(bytes(x))
            elif number == 2:
                values += struct.unpack(f"<{len(x) // 4}f", x)
            elif w == 0:
                values.append(_signed(x))
            else:
                i = 0
                while i < len(x):
                    y, i = _varint(x, i)
                    values.append(_signed(y))
    return kind, values


def _map(b: bytes, wanted=None):
    """(key, value bytes) of the entries of a map field; of repeated keys the first counts."""
    seen = set()
    for number, wire, entry in _fields(b):
        if number != 1 or wire != 2:
            continue
        key, value = "", b""
        for n, w, v in _fields(entry):
            if n == 1 and w == 2:
                key = v.decode("utf-8")
            elif n == 2 and w == 2:
                value = v
        if key not in seen and (wanted is None or key in wanted):
            seen.add(key)
            yield key, value


def parse_example(record: bytes, wanted=None) -> dict:
    """{feature: (kind, values)}; features in wanted only, if given."""
    out = {}
    for number, wire, v in _fields(record):
        if number == 1 and wire == 2:
            for k, f in _map(v, wanted):
                out.setdefault(k, _feature(f))
    return out


class Irregular(Exception):
    """A batch of records that columns() leaves to parse_example()."""


def _varints(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, and where it ends."""
    value, at, live = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        if (at[live] >= end[live]).any():
            raise ParseError("Unable to parse example.")
        b = buf[at[live]]
        value[live] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        at[live] += 1
        live = live[b > 0x7F]
        if not len(live):
            return value, at
    raise ParseError("Unable to parse example.")


def _spans(buf: np.ndarray, at: np.ndarray, end: np.ndarray):
    """All fields of many messages, the k-th of each at a time: message, number, wire type, start, stop, value if a varint.

    Fields of one message come in their order.
    """
    out = []
    at, live = at.copy(), np.flatnonzero(at < end)
    while len(live):
        stop = end[live]
        tag, x = _varints(buf, at[live], stop)
        kind, value = (tag & np.uint64(7)).astype(np.int64), np.zeros(len(live), np.uint64)
        some = np.flatnonzero((kind == 0) | (kind == 2))
        value[some], x[some] = _varints(buf, x[some], stop[some])
        if (~np.isin(kind, (0, 1, 2, 5))).any():
            raise ParseError("Unable to parse example.")
        if (value[kind == 2] > np.uint64(len(buf))).any():
            raise ParseError("Unable to parse example.")
        size = np.where(kind == 2, value.astype(np.int64), np.where(kind == 1, 8, np.where(kind == 5, 4, 0)))
        if (x + size > stop).any():
            raise ParseError("Unable to parse example.")
        out.append((live, (tag >> np.uint64(3)).astype(np.int64), kind, x, x + size, value))
        at[live] = x + size
        live = live[at[live] < stop]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _gathered(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    size = stop - start
    return buf[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def columns(records: pa.Array, wanted: dict[str, str]) -> list[pa.Array]:
    """C1, C3 for a batch: a list column of each wanted feature, all records parsed together, level by level.

    A feature whose kind is not the wanted one is an error. What is rare (a feature that sets its kind twice, lists in
    several encodings) raises Irregular.
    """
    records = records.cast(pa.large_binary()).fill_null(b"")
    n = len(records)
    off = np.frombuffer(records.buffers()[1], np.int64)[records.offset : records.offset + n + 1] if n else np.zeros(1, np.int64)
    data = records.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    m, number, kind, a, b, _ = _spans(buf, off[:-1].astype(np.int64), off[1:].astype(np.int64))
    keep = (number == 1) & (kind == 2)
    record, a, b = m[keep], a[keep], b[keep]
    m, number, kind, a, b, _ = _spans(buf, a, b)
    keep = (number == 1) & (kind == 2)
    record, a, b = record[m[keep]], a[keep], b[keep]
    order = np.argsort(record, kind="stable")
    record, a, b = record[order], a[order], b[order]
    key_a, key_b, val_a, val_b = (np.zeros(len(record), np.int64) for _ in range(4))
    m, number, kind, x, y, _ = _spans(buf, a, b)
    for field, lo, hi in ((1, key_a, key_b), (2, val_a, val_b)):
        some = (number == field) & (kind == 2)
        lo[m[some]], hi[m[some]] = x[some], y[some]  # the last one counts
    size, out = key_b - key_a, []
    for name, want in wanted.items():
        raw = np.frombuffer(name.encode(), np.uint8)
        some = np.flatnonzero(size == len(raw))
        some = some[(buf[key_a[some][:, None] + np.arange(len(raw))] == raw).all(1)] if len(raw) else some
        rows, first = np.unique(record[some], return_index=True)  # of repeated keys the first counts
        some = some[first]
        m, number, kind, x, y, _ = _spans(buf, val_a[some], val_b[some])
        known = (kind == 2) & (number >= 1) & (number <= 3)
        m, number, x, y = m[known], number[known], x[known], y[known]
        if len(np.unique(m)) != len(m):
            raise Irregular
        code = {"BYTES": 1, "FLOAT": 2, "INT": 3}[want]
        if (number != code).any():
            other = {1: "BYTES", 2: "FLOAT", 3: "INT"}[int(number[number != code][0])]
            raise ValueError(f"feature {name}: {other} values where {want} was expected")
        rows = rows[m]
        out.append(_list_column(buf, n, rows, x, y, want))
    return out


def _list_column(buf, n, rows, start, stop, want) -> pa.Array:
    """Lists of the values in the list messages [start, stop) of some rows; the other rows are null."""
    m, number, kind, a, b, value = _spans(buf, start, stop)
    keep = number == 1
    order = np.argsort(m[keep], kind="stable")
    m, kind, a, b, value = (x[keep][order] for x in (m, kind, a, b, value))
    if len(np.unique(kind)) > 1 or (want == "BYTES" and (kind != 2).any()) or (want == "INT" and not np.isin(kind, (0, 2)).all()):
        raise Irregular
    if want == "BYTES":
        per = np.ones(len(m), np.int64)
        ends = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(_gathered(buf, a, b))])
    elif want == "FLOAT":
        if len(kind) and not np.isin(kind[0], (2, 5)):
            raise Irregular
        if ((b - a) % 4).any():
            raise ParseError("Unable to parse example.")
        per = (b - a) // 4
        values = pa.array(_gathered(buf, a, b).view("<f4"))
    elif len(kind) and kind[0] == 0:
        per = np.ones(len(m), np.int64)
        values = pa.array(value.view(np.int64))
    else:
        data = _gathered(buf, a, b)
        last = data < 0x80
        ends = np.cumsum(b - a)
        if ((b > a) & ~last[np.maximum(ends - 1, 0)] if len(data) else np.zeros(0, bool)).any():
            raise ParseError("Unable to parse example.")
        total = np.concatenate([[0], np.cumsum(last)])
        per = total[ends] - total[ends - (b - a)]
        close = np.flatnonzero(last)
        begin = np.concatenate([[0], close[:-1] + 1]) if len(close) else close
        width = close - begin + 1
        if (width > 10).any():
            raise ParseError("Unable to parse example.")
        place = np.arange(len(data)) - np.repeat(begin, width)
        parts = (data & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
        values = pa.array((np.bitwise_or.reduceat(parts, begin) if len(begin) else np.zeros(0, np.uint64)).view(np.int64))
    held = np.zeros(n, np.int64)
    np.add.at(held, rows[m], per)
    there = np.zeros(n, bool)
    there[rows] = True
    offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~there))


def parse_sequence(record: bytes, wanted=None, wanted_steps=None) -> tuple[dict, dict]:
    """Context features, and {feature: [(kind, values) of each step]}."""
    context, steps = {}, {}
    for number, wire, v in _fields(record):
        if wire != 2:
            continue
        if number == 1:
            for k, f in _map(v, wanted):
                context.setdefault(k, _feature(f))
        elif number == 2:
            for k, f in _map(v, wanted_steps):
                steps.setdefault(k, [_feature(x) for n, w, x in _fields(f) if n == 1 and w == 2])
    return context, steps


def _long_varint(x: int) -> bytes:
    x &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


_SHORT = [_long_varint(x) for x in range(1 << 14)]


def _out_varint(x: int) -> bytes:
    return _SHORT[x] if 0 <= x < 1 << 14 else _long_varint(x)


def _delimited(number: int, b: bytes) -> bytes:
    return _out_varint(number << 3 | 2) + _out_varint(len(b)) + b


def build_feature(kind: str | None, values) -> bytes:
    if kind is None or values is None:
        return b""
    if kind == "BYTES":
        inner = b"".join(_delimited(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values)
    elif kind == "FLOAT":
        inner = _delimited(1, struct.pack(f"<{len(values)}f", *values)) if len(values) else b""
    else:
        inner = _delimited(1, b"".join(_out_varint(int(v)) for v in values)) if len(values) else b""
    return _delimited({"BYTES": 1, "FLOAT": 2, "INT": 3}[kind], inner)


def _entry(key: str, value: bytes) -> bytes:
    return _delimited(1, _delimited(1, key.encode()) + _delimited(2, value))


def build_example(features: dict) -> bytes:
    """The record of {feature: (kind, values)}; None for values leaves the kind unset."""
    return _delimited(1, b"".join(_entry(k, build_feature(*v)) for k, v in features.items()))


def build_sequence(context: dict, steps: dict) -> bytes:
    a = b"".join(_entry(k, build_feature(*v)) for k, v in context.items())
    b = b"".join(_entry(k, b"".join(_delimited(1, build_feature(*f)) for f in fs)) for k, fs in steps.items())
    return _delimited(1, a) + _delimited(2, b)


def _varint_sizes(x: np.ndarray) -> np.ndarray:
    x, size = x.astype(np.uint64, copy=False), np.ones(len(x), np.int64)
    for k in range(1, 10):
        more = x >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    return size


def _put_varints(buf: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Writes numbers at their places; gives where each of them ends."""
    x, size = x.astype(np.uint64, copy=False), _varint_sizes(x)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        byte = (x[here] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8)
        buf[at[here] + k] = byte | ((size[here] > k + 1) << 7).astype(np.uint8)
    return at + size


def _delimited_sizes(body: np.ndarray) -> np.ndarray:
    return 1 + _varint_sizes(body) + body


def _put_heads(buf: np.ndarray, at: np.ndarray, number: int, body: np.ndarray) -> np.ndarray:
    """Tag and length of a delimited field at each place; gives where the bodies begin."""
    buf[at] = number << 3 | 2
    return _put_varints(buf, at + 1, body)


def _spread(buf: np.ndarray, at: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
    """Copies the runs of data that end at `ends` to the places `at`."""
    sizes = np.diff(ends, prepend=0)
    buf[np.repeat(at - (ends - sizes), sizes) + np.arange(len(data))] = data


class ListFeature:
    """One feature of a batch of records: lists of values by row offsets, null where not valid."""

    def __init__(self, name: str, kind: str | None, valid: np.ndarray, offsets: np.ndarray, values: pa.Array | None):
        if values is not None and values.null_count:
            raise ValueError(f"feature {name}: a null within a list")
        self.head = _delimited(1, name.encode())
        self.kind, self.valid, self.offsets = kind, valid & (kind is not None), offsets
        if kind is None:
            payload = np.zeros(len(valid), np.int64)
        elif kind == "BYTES":
            held = values.cast(pa.large_binary())
            _, ends, data = held.buffers()
            ends = np.frombuffer(ends, np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
            self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
            self.ends = ends[1:] - ends[0]
            self.lengths = np.diff(ends)
            self.sizes = _delimited_sizes(self.lengths)
        elif kind == "FLOAT":
            self.data = np.ascontiguousarray(values.cast(pa.float32()).to_numpy(zero_copy_only=False), "<f4")
            self.sizes = np.full(len(self.data), 4, np.int64)
        else:
            self.data = values.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
            self.sizes = _varint_sizes(self.data)
        if kind is not None:
            self.upto = np.concatenate([[0], np.cumsum(self.sizes)])
            payload = self.upto[offsets[1:]] - self.upto[offsets[:-1]]
        self.payload = payload  # bytes of the values
        self.list = payload if kind == "BYTES" else np.where(payload > 0, _delimited_sizes(payload), 0)
        self.feature = np.where(self.valid, _delimited_sizes(self.list), 0)
        self.entry = len(self.head) + _delimited_sizes(self.feature)

    def put(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Writes the entry of every row at its place; gives where each ends."""
        at = _put_heads(buf, at, 1, self.entry)
        head = np.frombuffer(self.head, np.uint8)
        buf[at[:, None] + np.arange(len(head))] = head
        at = _put_heads(buf, at + len(head), 2, self.feature)
        end = at + self.feature
        rows = np.flatnonzero(self.valid)
        if len(rows):
            at = _put_heads(buf, at[rows], {"BYTES": 1, "FLOAT": 2, "INT": 3}[self.kind], self.list[rows])
            full = self.payload[rows] > 0
            rows, at = rows[full], at[full]
            if self.kind != "BYTES":
                at = _put_heads(buf, at, 1, self.payload[rows])
            count = np.diff(self.offsets)[rows]
            place = np.repeat(at - self.upto[self.offsets[rows]], count) + self.upto[:-1]  # rows that aren't valid have no values
            if self.kind == "BYTES":
                _spread(buf, _put_heads(buf, place, 1, self.lengths), self.data, self.ends)
            elif self.kind == "FLOAT":
                buf[place[:, None] + np.arange(4)] = self.data.view(np.uint8).reshape(-1, 4)
            else:
                _put_varints(buf, place, self.data)
        return end


def build_examples(n: int, features: list[ListFeature]) -> pa.Array:
    """The n records of a batch's features. Lengths are summed up from the values outwards; then all bytes are scattered
    into one buffer, for a feature and a kind of byte at a time."""
    body = sum((_delimited_sizes(f.entry) for f in features), np.zeros(n, np.int64))
    ends = np.concatenate([[0], np.cumsum(_delimited_sizes(body))])
    buf = np.zeros(ends[-1], np.uint8)
    at = _put_heads(buf, ends[:-1], 1, body)
    for f in features:
        at = f.put(buf, at)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(buf)]).cast(pa.binary())

"""The protobuf wire format: enough to read messages without their schema, and to write those of tests."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator


class WireError(ValueError):
    """Bytes that are no message."""


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next offset) of a base-128 number of at most ten bytes."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise WireError(f"a number at {at} is cut off")
        b = data[at + k]
        value |= (b & 127) << (7 * k)
        if b < 128:
            return value, at + k + 1
    raise WireError(f"a number at {at} has over 64 bits")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field in order: numbers, or bytes that only a schema can read."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        number, kind = key >> 3, key & 7
        if not number:
            raise WireError("a field without a number")
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(data):
                raise WireError(f"field {number} is cut off")
            value, at = struct.unpack_from("<Q" if kind == 1 else "<I", data, at)[0], at + size
        elif kind == 2:
            size, at = read_varint(data, at)
            if at + size > len(data):
                raise WireError(f"field {number} is cut off")
            value, at = data[at : at + size], at + size
        else:
            raise WireError(f"field {number} has an unknown kind {kind}")
        yield number, value


def decode(data: bytes) -> dict[int, list[int | bytes]]:
    out: dict[int, list[int | bytes]] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def numbers(message: dict[int, list], number: int) -> list[int]:
    """A repeated number, packed or not."""
    out: list[int] = []
    for value in message.get(number, ()):
        if isinstance(value, int):
            out.append(value)
            continue
        at = 0
        while at < len(value):
            x, at = read_varint(value, at)
            out.append(x)
    return out


def texts(message: dict[int, list], number: int) -> list[str]:
    return [bytes(v).decode("utf-8", "replace") for v in message.get(number, ()) if not isinstance(v, int)]


def text(message: dict[int, list], number: int) -> str:
    return next(iter(reversed(texts(message, number))), "")


def number(message: dict[int, list], n: int, default: int = 0) -> int:
    return next((v for v in reversed(message.get(n, ())) if isinstance(v, int)), default)


def messages(message: dict[int, list], number: int) -> Iterator[dict[int, list]]:
    return (decode(v) for v in message.get(number, ()) if not isinstance(v, int))


def write_varint(value: int) -> bytes:
    if value < 0:
        raise WireError("numbers are not negative")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def write_field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return write_varint(number << 3) + write_varint(value)
    body = value.encode() if isinstance(value, str) else bytes(value)
    return write_varint(number << 3 | 2) + write_varint(len(body)) + body


def write_packed(number: int, values: Iterable[int]) -> bytes:
    return write_field(number, b"".join(map(write_varint, values)))


def write_message(*parts: bytes) -> bytes:
    return b"".join(parts)

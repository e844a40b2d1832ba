"""HDF5 files (NetCDF4 files are such) read from their bytes, after the published file format.

Read are groups of both kinds (symbol tables, and links in the header), arrays that are compact,
contiguous or chunked under a version 1 tree, with deflate, shuffle and checksum filters, of
numbers and fixed texts, and attributes in the header. Dense groups, other chunk indexes and other
types are an error that says so.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np

# The signature, and the numbers of header messages and filters that are read.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, LINKS, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF


class Unread(ValueError):
    """A part of the format that isn't read."""


def _numbers(data: bytes, at: int, n: int, kind: str = "Q") -> tuple[int, ...]:
    return struct.unpack_from(f"<{n}{kind}", data, at)


def shape_of(data: bytes) -> tuple[int, ...]:
    """A dataspace message."""
    version, rank = data[0], data[1]
    return _numbers(data, 8 if version == 1 else 4, rank)


def type_of(data: bytes) -> np.dtype:
    """A datatype message: integers, floats and fixed texts."""
    kind, bits, size = data[0] & 15, data[1], _numbers(data, 4, 1, "I")[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    raise Unread(f"datatype of class {kind}")


@dataclass
class Array:
    """An array of a file: its shape, type and attributes; read() gives the values."""

    data: bytes
    shape: tuple[int, ...]
    dtype: np.dtype
    layout: bytes
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    fill: bytes = b""
    attributes: dict[str, Any] = field(default_factory=dict)

    def read(self) -> np.ndarray:
        if self.layout[0] != 3:
            raise Unread(f"layout version {self.layout[0]}")
        kind, count = self.layout[1], int(np.prod(self.shape, dtype=np.int64))
        if kind == 0:
            return np.frombuffer(self.layout, self.dtype, count, 4).reshape(self.shape)
        blank = np.frombuffer(self.fill, self.dtype, 1)[0] if len(self.fill) == self.dtype.itemsize else np.zeros(1, self.dtype)[0]
        if kind == 1:
            at = _numbers(self.layout, 2, 1)[0]
            return np.full(self.shape, blank, self.dtype) if at == NOWHERE else np.frombuffer(self.data, self.dtype, count, at).reshape(self.shape)
        rank = self.layout[2] - 1
        tree, chunk = _numbers(self.layout, 3, 1)[0], _numbers(self.layout, 11, rank, "I")
        out = np.full(self.shape, blank, self.dtype)
        for origin, size, skipped, at in _chunks(self.data, tree, rank):
            block = self._plain(self.data[at : at + size], skipped).reshape(chunk)
            ends = [min(o + c, n) for o, c, n in zip(origin, chunk, self.shape, strict=True)]
            out[tuple(slice(o, e) for o, e in zip(origin, ends, strict=True))] = block[tuple(slice(0, e - o) for o, e in zip(origin, ends, strict=True))]
        return out

    def _plain(self, raw: bytes, skipped: int) -> np.ndarray:
        """A chunk with its filters undone, the last first."""
        for k in reversed(range(len(self.filters))):
            number, values = self.filters[k]
            if skipped >> k & 1:
                continue
            if number == DEFLATE:
                raw = zlib.decompress(raw)
            elif number == SHUFFLE:
                size = values[0] if values else self.dtype.itemsize
                raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
            elif number == CHECKSUM:
                raw = raw[:-4]
            else:
                raise Unread(f"filter {number}")
        return np.frombuffer(raw, self.dtype)


def _chunks(data: bytes, at: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
    """(origin, bytes, filters not applied, place) of every chunk below a node of a version 1 tree."""
    if at == NOWHERE:
        return
    if data[at : at + 4] != b"TREE":
        raise Unread("chunk index")
    level, n = data[at + 5], _numbers(data, at + 6, 1, "H")[0]
    step = 8 + 8 * (rank + 1)
    for i in range(n):
        key = at + 24 + i * (step + 8)
        child = _numbers(data, key + step, 1)[0]
        if level:
            yield from _chunks(data, child, rank)
        else:
            size, skipped = _numbers(data, key, 2, "I")
            yield _numbers(data, key + 8, rank), size, skipped, child


def _messages(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(type, body) of every message of an object's header, in all of its blocks."""
    if data[at : at + 4] == b"OHDR":
        flags = data[at + 5]
        start = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
        width = 1 << (flags & 3)
        blocks = [(start + width, int.from_bytes(data[start : start + width], "little"))]
        head, tracked = 4, 2 if flags & 4 else 0
    else:
        blocks, head, tracked = [(at + 16, _numbers(data, at + 8, 1, "I")[0])], 8, 0
    while blocks:
        place, size = blocks.pop(0)
        end = place + size
        while place + head + tracked <= end:
            if head == 4:
                kind, n = data[place], _numbers(data, place + 1, 1, "H")[0]
            else:
                kind, n = _numbers(data, place, 2, "H")
            body = data[place + head + tracked : place + head + tracked + n]
            place += head + tracked + n
            if kind == CONTINUED:
                to, length = _numbers(body, 0, 2)
                blocks.append((to + 4, length - 8) if head == 4 else (to, length))
            else:
                yield kind, body


def _attribute(body: bytes) -> tuple[str, Any]:
    version = body[0]
    name_size, type_size, space_size = _numbers(body, 2, 3, "H")
    at = 9 if version == 3 else 8
    padded = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
    name = body[at : at + name_size].split(b"\0")[0].decode()
    at += padded(name_size)
    kind = body[at : at + type_size]
    at += padded(type_size)
    shape = shape_of(body[at : at + space_size])
    at += padded(space_size)
    dtype = type_of(kind)
    values = np.frombuffer(body, dtype, int(np.prod(shape, dtype=np.int64)), at).reshape(shape)
    plain = [v.split(b"\0")[0].decode("utf-8", "replace") if dtype.kind == "S" else v.item() for v in values.ravel()]
    return name, plain[0] if len(plain) == 1 else plain


def _symbols(data: bytes, tree: int, names: int) -> Iterator[tuple[str, int]]:
    """(name, header) of the members that a tree of symbol tables lists."""
    if data[tree : tree + 4] == b"SNOD":
        for i in range(_numbers(data, tree + 6, 1, "H")[0]):
            name, header = _numbers(data, tree + 8 + 40 * i, 2)
            yield data[names + name : data.index(b"\0", names + name)].decode(), header
        return
    for i in range(_numbers(data, tree + 6, 1, "H")[0]):
        yield from _symbols(data, _numbers(data, tree + 32 + 16 * i, 1)[0], names)


def _link(body: bytes) -> tuple[str, int] | None:
    """(name, header) of a link message; None for soft and outer links."""
    flags, at = body[1], 2
    kind = body[at] if flags & 8 else 0
    at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
    width = 1 << (flags & 3)
    size = int.from_bytes(body[at : at + width], "little")
    at += width
    return None if kind else (body[at : at + size].decode(), _numbers(body, at + size, 1)[0])


def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
    version, n = body[0], body[1]
    out, at = [], 8 if version == 1 else 2
    for _ in range(n):
        number = _numbers(body, at, 1, "H")[0]
        named = version == 1 or number >= 256
        name = _numbers(body, at + 2, 1, "H")[0] if named else 0
        at += 4 if named else 2
        count = _numbers(body, at + 2, 1, "H")[0]
        at += 4 + (-(-name // 8) * 8 if version == 1 else name)
        out.append((number, _numbers(body, at, count, "I")))
        at += 4 * count + (4 if version == 1 and count % 2 else 0)
    return out


def _fill(body: bytes) -> bytes:
    if body[0] == 3:
        return body[6 : 6 + _numbers(body, 2, 1, "I")[0]] if body[1] & 0x20 else b""
    return body[8 : 8 + _numbers(body, 4, 1, "I")[0]] if body[3] and len(body) >= 8 else b""


def _object(data: bytes, at: int, path: str, found: dict[str, Array], groups: dict[str, dict[str, Any]], above: tuple[int, ...]) -> None:
    parts: dict[int, bytes] = {}
    attributes: dict[str, Any] = {}
    members: list[tuple[str, int]] = []
    for kind, body in _messages(data, at):
        if kind == ATTRIBUTE:
            try:
                name, value = _attribute(body)
                attributes[name] = value
            except Unread:
                continue
        elif kind == LINK:
            if link := _link(body):
                members.append(link)
        elif kind == SYMBOLS:
            tree, heap = _numbers(body, 0, 2)
            members += _symbols(data, tree, _numbers(data, heap + 24, 1)[0])
        elif kind == LINKS and _numbers(body, 2 + (8 if body[1] & 1 else 0), 1)[0] != NOWHERE:
            raise Unread("dense groups")
        else:
            parts.setdefault(kind, body)
    if LAYOUT in parts and TYPE in parts:
        try:
            dtype = type_of(parts[TYPE])
        except Unread:
            return
        found[path] = Array(data, shape_of(parts[SPACE]), dtype, parts[LAYOUT], _filters(parts[FILTERS]) if FILTERS in parts else [], _fill(parts[FILL]) if FILL in parts else b"", attributes)
        return
    groups[path] = attributes
    for name, to in members:
        if to not in above:
            _object(data, to, f"{path}/{name}" if path else name, found, groups, (*above, to))


def opened(data: bytes) -> tuple[dict[str, Array], dict[str, dict[str, Any]]]:
    """(arrays by path, attributes of groups by path; the root's path is empty)."""
    start = next((at for at in (0, 512, 1024, 2048) if data[at : at + 8] == SIGNATURE), None)
    if start is None:
        raise ValueError("not an HDF5 file")
    version = data[start + 8]
    sizes = data[start + 13 : start + 15] if version < 2 else data[start + 9 : start + 11]
    if sizes != b"\x08\x08":
        raise Unread(f"offsets and lengths of {sizes[0]} and {sizes[1]} bytes")
    root = _numbers(data, start + (24 + 4 * version + 32 + 8 if version < 2 else 36), 1)[0]
    arrays: dict[str, Array] = {}
    groups: dict[str, dict[str, Any]] = {}
    _object(data, root, "", arrays, groups, (root,))
    return arrays, groups

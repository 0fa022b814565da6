"""The tagged container of ``.set`` files (level 5 MAT): elements with a type and a length, nested, some of them deflated.

``read`` gives the variables by name: numbers as arrays in their own shape, texts as str, cells as lists, structs as a list of
dicts. ``write`` makes such a file of the same kinds of values. Damaged or unknown content raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: number types by their tag, and the tags and array classes that are no numbers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, DEFLATED = 14, 15
CELL, STRUCT, CHAR, SPARSE, FIRST_NUMBER, LAST_NUMBER = 1, 2, 4, 5, 6, 15
HEADER = 128
CLASSES = {"f8": 6, "f4": 7, "i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "i8": 14, "u8": 15}


class _Elements:
    """One element after the other of a piece of the file."""

    def __init__(self, data: memoryview, order: str) -> None:
        self.data, self.order, self.at = data, order, 0

    def __bool__(self) -> bool:
        return self.at + 8 <= len(self.data)

    def next(self) -> tuple[int, memoryview]:
        if not self:
            raise ValueError("an element is cut off")
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        start = self.at + 8
        if kind >> 16:
            kind, size, start = kind & 0xFFFF, kind >> 16, self.at + 4
            self.at += 8
        else:
            self.at = start + size + (-size % 8 if kind != DEFLATED else 0)
        if start + size > len(self.data):
            raise ValueError("an element is cut off")
        return kind, self.data[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        if kind not in NUMBERS:
            raise ValueError(f"element type {kind} is no number")
        return np.frombuffer(data, self.order + NUMBERS[kind])


def _text(kind: int, data: memoryview, order: str) -> str:
    if kind in TEXTS:
        return bytes(data).decode(TEXTS[kind] if kind == 16 else TEXTS[kind] + ("-le" if order == "<" else "-be"))
    return "".join(map(chr, np.frombuffer(data, order + NUMBERS[kind])))


def _matrix(data: memoryview, order: str) -> tuple[str, object]:
    parts = _Elements(data, order)
    if not parts:
        return "", np.zeros((0, 0))
    flags = parts.numbers()
    kind = int(flags[0]) & 0xFF
    shape = tuple(int(n) for n in parts.numbers())
    name = bytes(parts.next()[1]).decode("latin-1")
    size = int(np.prod(shape, dtype=np.int64))
    if kind == CHAR:
        text = _text(*parts.next(), order)
        return name, text if len(shape) < 2 or shape[0] <= 1 else "".join(np.array(list(text)).reshape(shape, order="F").ravel())
    if kind == CELL:
        return name, [_matrix(parts.next()[1], order)[1] for _ in range(size)]
    if kind == STRUCT:
        width = int(parts.numbers()[0])
        fields = bytes(parts.next()[1])
        names = [fields[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(fields), width)]
        return name, [{n: _matrix(parts.next()[1], order)[1] for n in names} for _ in range(size)]
    if FIRST_NUMBER <= kind <= LAST_NUMBER:
        x = parts.numbers()
        if len(x) != size:
            raise ValueError(f"{name or 'array'} holds {len(x)} of {size} numbers")
        return name, x.reshape(shape, order="F")
    raise ValueError(f"array class {kind} isn't read")


def read(data: bytes) -> dict[str, object]:
    if data[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in data[:HEADER]:
        raise ValueError("a version 7.3 file (HDF5)")
    mark = bytes(data[126:128])
    if len(data) < HEADER or mark not in (b"IM", b"MI"):
        raise ValueError("no level 5 MAT file")
    order = "<" if mark == b"IM" else ">"
    out: dict[str, object] = {}
    elements = _Elements(memoryview(data)[HEADER:], order)
    while elements:
        kind, body = elements.next()
        if kind == DEFLATED:
            try:
                kind, body = _Elements(memoryview(zlib.decompress(body)), order).next()
            except zlib.error as e:
                raise ValueError(f"a deflated element is damaged: {e}") from e
        if kind == MATRIX:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _array(name: str, value: object) -> bytes:
    def head(kind: int, shape: tuple[int, ...]) -> bytes:
        dims = np.array(shape, "<i4").tobytes()
        return _element(6, struct.pack("<II", kind, 0)) + _element(5, dims) + _element(1, name.encode("latin-1"))

    if isinstance(value, str):
        body = head(CHAR, (1, len(value))) + _element(4, np.array([ord(c) for c in value], "<u2").tobytes())
    elif isinstance(value, dict) or (isinstance(value, list) and value and isinstance(value[0], dict)):
        rows = [value] if isinstance(value, dict) else value
        names = list(rows[0])
        width = max(map(len, names)) + 1
        body = head(STRUCT, (1, len(rows))) + _element(5, struct.pack("<i", width)) + _element(1, b"".join(n.encode().ljust(width, b"\0") for n in names))
        body += b"".join(_array("", r[n]) for r in rows for n in names)
    elif isinstance(value, list):
        body = head(CELL, (1, len(value))) + b"".join(_array("", v) for v in value)
    else:
        x = np.atleast_2d(np.asarray(value))
        kind = x.dtype.str[1:]
        number = next(k for k, v in NUMBERS.items() if v == kind)
        body = head(CLASSES[kind], x.shape) + _element(number, x.astype("<" + kind).tobytes(order="F"))
    return _element(MATRIX, body)


def write(variables: dict[str, object], deflated: bool = True) -> bytes:
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        body = _array(name, value)
        out += struct.pack("<II", DEFLATED, len(z := zlib.compress(body))) + z if deflated else body
    return out

"""What Parquet files say about their values without being scanned: footers, page headers and dictionary pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

#: Fixed values of the Parquet format: page types, encodings and codecs.
DATA_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 2, 3
PLAIN_DICTIONARY, RLE_DICTIONARY = 2, 8
NUMPY_TYPES = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}


@dataclass
class Page:
    kind: int
    values: int
    encoding: int
    body: int  #: offset of the page's body in the file
    compressed: int
    size: int


def open_file(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class _Compact:
    """Reads a structure of the Thrift compact protocol into {field number: value}."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def number(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def struct(self) -> dict[int, Any]:
        out, field = {}, 0
        while head := self.data[self.at]:
            self.at += 1
            field = field + (head >> 4) if head >> 4 else self.number()
            out[field] = self.value(head & 15)
        self.at += 1
        return out

    def value(self, kind: int) -> Any:
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (4, 5, 6):
            return self.number()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"type {kind} in a page header")


def pages(f: pa.NativeFile, column: pq.ColumnChunkMetaData) -> Iterator[Page]:
    """The pages of a column chunk by their headers; bodies are skipped, not read."""
    at = column.dictionary_page_offset if column.has_dictionary_page else column.data_page_offset
    end = at + column.total_compressed_size
    while at < end:
        size = 512
        while True:  # headers may hold long extrema
            f.seek(at)
            data = f.read(min(size, end - at))
            try:
                reader = _Compact(data)
                h = reader.struct()
                break
            except IndexError:
                if size >= end - at:
                    raise
                size *= 8
        part = h.get(5) or h.get(7) or h.get(8) or {}
        encoding = part.get(4 if h[1] == DATA_PAGE_V2 else 2, -1)
        yield Page(h[1], part.get(1, 0), encoding, at + reader.at, h[3], h[2])
        at += reader.at + h[3]


def dictionary(f: pa.NativeFile, column: pq.ColumnChunkMetaData) -> pa.Array | None:
    """The values in a chunk's dictionary if all its data pages use it, so that they are the chunk's distinct values; else None."""
    if not column.has_dictionary_page:
        return None
    first = None
    for p in pages(f, column):
        if p.kind == DICTIONARY_PAGE:
            first = p
        elif p.kind in (DATA_PAGE, DATA_PAGE_V2) and p.encoding not in (PLAIN_DICTIONARY, RLE_DICTIONARY):
            return None
    if first is None:
        return None
    f.seek(first.body)
    body = f.read(first.compressed)
    if column.compression != "UNCOMPRESSED":
        body = pa.Codec(column.compression.lower() if column.compression != "LZ4" else "lz4_raw").decompress(body, first.size)
    body = memoryview(body)
    if column.physical_type in NUMPY_TYPES:
        return pa.array(np.frombuffer(body, NUMPY_TYPES[column.physical_type], first.values))
    if column.physical_type != "BYTE_ARRAY":
        return None
    out, at = [], 0
    for _ in range(first.values):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(bytes(body[at + 4 : at + 4 + n]))
        at += 4 + n
    return pa.array(out, pa.binary())


def statistics(column: pq.ColumnChunkMetaData) -> tuple[int | None, Any, Any]:
    """(nulls, min, max) of a chunk as far as its footer states them; extrema of floating-point chunks with NaN are not stated by writers."""
    s = column.statistics
    if s is None:
        return None, None, None
    low, high = (s.min, s.max) if s.has_min_max else (None, None)
    return (s.null_count if s.has_null_count else None), low, high

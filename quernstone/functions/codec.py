"""Codecs of the index: variable-length integers, id hashes and the byte form of a postings list."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quernstone.session import ship_package


class CodecError(ValueError):
    """Bytes that end too early."""


def encode_ints(values: list[int] | None) -> bytes:
    """Each integer in groups of seven bits, lowest first; all but the last byte of one have the high bit set."""
    out = bytearray()
    for v in values or ():
        v &= (1 << 64) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def decode_ints(data: bytes | None) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data or b"":
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    if shift:
        raise CodecError("truncated integer")
    return out


def id_hash(doc_id: str) -> int:
    """Polynomial hash in base 31 over the characters, 64 bits with sign, made positive. Not invertible."""
    value = 0
    for c in doc_id:
        value = (value * 31 + ord(c)) & ((1 << 64) - 1)
    return abs(value - (1 << 64) if value >> 63 else value)


def encode_ids(ids: list[str] | None) -> bytes:
    """Hashes of ids as variable-length integers. Ids cannot be had back from them; ``decode_ints`` gives the hashes."""
    return encode_ints([id_hash(i) for i in ids or ()])


def encode_postings(postings: list[tuple[str, int, list[int]]] | None) -> bytes:
    """(doc_id, tf, positions): counts and id lengths in 16 bits (they wrap), positions in 32, all big-endian."""
    if not postings:
        return b""
    out = [struct.pack(">H", len(postings) & 0xFFFF)]
    for doc_id, tf, positions in postings:
        name = doc_id.encode()
        out.append(struct.pack(f">H{len(name)}sH{len(positions)}I", len(name) & 0xFFFF, name, tf & 0xFFFF, *(p & 0xFFFFFFFF for p in positions)))
    return b"".join(out)


def decode_postings(data: bytes) -> list[tuple[str, int, list[int]]]:
    """The inverse, for lists whose counts did not wrap; an empty list from no bytes."""
    if not data:
        return []
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise CodecError("truncated postings")
        at += n
        return data[at - n : at]

    out = []
    for _ in range(struct.unpack(">H", take(2))[0]):
        name = take(struct.unpack(">H", take(2))[0]).decode()
        tf = struct.unpack(">H", take(2))[0]
        out.append((name, tf, list(struct.unpack(f">{tf}I", take(4 * tf)))))
    return out


def compress_ratio(original: Column, encoded: Column) -> Column:
    return F.when(original == 0, F.lit(1.0)).otherwise(encoded / original)


def estimated_size(count: Column) -> Column:
    return F.floor(count * 3 / 2).cast("int")


def int_size(value: Column) -> Column:
    """Bytes of an integer in the variable-length form, without encoding it."""
    size = F.lit(9)
    for n in range(8, 0, -1):
        size = F.when(value < (1 << (7 * n)), F.lit(n)).otherwise(size)
    return size


def gaps(positions: Column) -> Column:
    """First value and differences of ascending integers."""
    return F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.get(positions, i - 1)))


def encode_ints_column(values: Column) -> Column:
    ship_package(SparkSession.active())

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else encode_ints([int(x) for x in v]))

    return encode(values)


def decode_ints_column(data: Column) -> Column:
    ship_package(SparkSession.active())

    @F.pandas_udf("array<bigint>")
    def decode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda d: None if d is None else decode_ints(d))

    return decode(data)

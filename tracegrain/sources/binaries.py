"""Binaries as tables: whole files as hex, data segments and exports of portable executables.

Headers are read from the bytes in Arrow batches; a file that is no such executable, or a broken one, gives no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import HEADER_SUFFIXES, SOURCE_SUFFIXES

#: Suffixes of the files of each kind.
SUFFIXES = {"source": SOURCE_SUFFIXES, "header": HEADER_SUFFIXES, "executable": ("exe", "dll", "lib"), "local": ("dll", "so", "exe")}
SEGMENTS = (".rdata", ".data")


def read_binaries(spark: SparkSession, path: str, kind: str = "local") -> DataFrame:
    """path, data of the files below a folder with a suffix of the kind; the listing prunes, contents are read when used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES[kind])})$")).select("path", F.col("content").alias("data"))


def as_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def is_pe32(data: Column) -> Column:
    """True for 32-bit, false for 64-bit portable executables, null for others: the machine field after the PE mark."""
    at = lambda k: F.conv(F.hex(F.substring(data, 0x3C + 1 + k, 1)), 16, 10).cast("long")
    start = at(0) + at(1) * 256 + at(2) * 65536
    machine = F.hex(F.substring(data, start.cast("int") + 5, F.lit(2)))
    mark = F.hex(F.substring(data, start.cast("int") + 1, F.lit(4)))
    return F.when((F.hex(F.substring(data, 1, 2)) == "4D5A") & (mark == "50450000"), F.when(machine == "4C01", True).when(machine == "6486", False))


def _sections(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, raw offset, raw size, virtual address, virtual size)"""
    (start,) = struct.unpack_from("<I", data, 0x3C)
    if data[:2] != b"MZ" or data[start : start + 4] != b"PE\0\0":
        raise ValueError("no portable executable")
    count, optional = struct.unpack_from("<2xH12xH", data, start + 4)
    for i in range(count):
        name, vsize, vaddr, size, offset = struct.unpack_from("<8s4I", data, start + 24 + optional + 40 * i)
        yield name.rstrip(b"\0").decode("latin-1"), offset, size, vaddr, vsize


def data_segments(data: bytes) -> list[tuple[str, bytes]]:
    return [(name, data[offset : offset + size]) for name, offset, size, _, _ in _sections(data) if name in SEGMENTS]


def exports(data: bytes) -> list[tuple[int, str]]:
    """(ordinal, name) of the export directory; an export without a name is called `None`."""
    sections = list(_sections(data))

    def raw(rva: int) -> int:
        for _, offset, size, vaddr, vsize in sections:
            if vaddr <= rva < vaddr + max(size, vsize):
                return rva - vaddr + offset
        raise ValueError("address outside the sections")

    (start,) = struct.unpack_from("<I", data, 0x3C)
    (magic,) = struct.unpack_from("<H", data, start + 24)
    (rva,) = struct.unpack_from("<I", data, start + 24 + (112 if magic == 0x20B else 96))
    if not rva:
        return []
    base, functions, names, _, name_table, ordinal_table = struct.unpack_from("<6I", data, raw(rva) + 16)
    named = {}
    for i in range(names):
        (ordinal,) = struct.unpack_from("<H", data, raw(ordinal_table) + 2 * i)
        (at,) = struct.unpack_from("<I", data, raw(name_table) + 4 * i)
        text = data[raw(at) :]
        named[ordinal] = text[: text.index(b"\0")].decode("latin-1")
    return [(base + i, named.get(i, "None")) for i in range(functions)]


def _each(read, columns: list[str]):
    def run(batches):
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["data"]):
                try:
                    out += [(path, *x) for x in read(bytes(data))]
                except (ValueError, struct.error, IndexError):
                    continue
            yield pd.DataFrame(out, columns=["bin_file", *columns])

    return run


def segments(binaries: DataFrame) -> DataFrame:
    """bin_file, seg, hex: .rdata and .data of each executable."""
    rows = binaries.select("path", "data").mapInPandas(_each(data_segments, ["seg", "data"]), "bin_file string, seg string, data binary")
    return rows.select("bin_file", "seg", as_hex(F.col("data")).alias("hex"))


def exported_names(binaries: DataFrame) -> DataFrame:
    """bin_file, ordinal, name"""
    return binaries.select("path", "data").mapInPandas(_each(exports, ["ordinal", "name"]), "bin_file string, ordinal int, name string")

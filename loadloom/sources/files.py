"""Listings, times and contents of files in any store that Spark reads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    is_folder: bool
    size: int
    modified: float


def _at(path: str):
    """The path and its store, as Hadoop knows them."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _entry(s) -> Entry:
    return Entry(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime() / 1000)


def entries(folder: str) -> list[Entry]:
    """What is in a folder, by name."""
    p, store = _at(folder)
    return sorted(map(_entry, store.listStatus(p)))


def entry(path: str) -> Entry | None:
    p, store = _at(path)
    return _entry(store.getFileStatus(p)) if store.exists(p) else None


def delete(path: str) -> None:
    p, store = _at(path)
    store.delete(p, True)


def make_folder(path: str) -> None:
    p, store = _at(path)
    store.mkdirs(p)


def save(path: str, data: bytes) -> None:
    """Write one file, such as a report, over what is there."""
    p, store = _at(path)
    out = store.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def content(path: str) -> bytes:
    """The bytes of one file, such as a workbook."""
    return bytes(SparkSession.active().read.format("binaryFile").load(path).select("content").first()[0])


def first_line(path: str) -> str:
    row = SparkSession.active().read.text(path).first()
    return row[0].removeprefix("﻿") if row else ""

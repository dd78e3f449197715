"""Folders of many files, spread over subfolders: listed and read by tasks, so that the driver holds no list of them.

Spark's own readers list files on the driver and give a task a few dozen; these are for a file a recording, millions of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subfolders that files are spread over, and tasks that list and read a folder.
SPREAD = 128
#: Bytes of files that a task hands on at once.
BATCH_BYTES = 4 << 20


def place(uri: str):
    """The store of a path, the path in it, and what stands before it in the names of files."""
    from pyarrow import fs

    root = re.sub(r"^file:/+", "file:///", uri.rstrip("/"))
    store, inner = fs.FileSystem.from_uri(root)
    return store, inner, root[: root.index(inner)] or "file://"


def fits(glob: str) -> Callable[[str], bool]:
    """Whether a name fits a glob, which may have alternatives in one pair of braces; hidden names never fit."""
    before, inside, after = re.fullmatch(r"([^{}]*)(?:\{([^{}]*)\})?([^{}]*)", glob).groups()
    globs = [before + x + after for x in (inside or "").split(",")]
    return lambda name: not name.startswith((".", "_")) and any(fnmatchcase(name, g) for g in globs)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """path in the store, length (null for a folder) of what lies in a folder, or of the file itself, dealt over SPREAD tasks."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for x in batches:
            for uri in x["path"]:
                store, inner, _ = place(uri)
                top = store.get_file_info(inner)
                found = [top] if top.is_file else store.get_file_info(fs.FileSelector(inner))
                kept = [(f.path, f.size) for f in found if not f.base_name.startswith((".", "_")) or f is top]
                yield pd.DataFrame({"path": [p for p, _ in kept], "length": pd.array([n for _, n in kept], "Int64")})

    return spark.createDataFrame([(path,)], "path string").mapInPandas(look, "path string, length long").repartition(SPREAD, "path")


def _read(spark: SparkSession, path: str, glob: str, most: int | None) -> DataFrame:
    """path, length, content (the first bytes, `most` of them, or all) of the files below a folder whose names fit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _, before = place(path)
        good, rows, held = fits(glob), [], 0
        for x in batches:
            for inner, length in zip(x["path"], x["length"]):
                below = [(inner, int(length))] if pd.notna(length) else [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
                for at, size in below:
                    steps = at[len(inner) + 1 :].split("/")
                    if not good(at.rsplit("/", 1)[1]) or any(s.startswith((".", "_")) for s in steps):
                        continue
                    with store.open_input_file(at) as f:
                        rows.append((before + at, size, f.read(size if most is None else min(most, size))))
                    held += len(rows[-1][2]) + 100
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "length", "content"])
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return _entries(spark, path).mapInPandas(read, "path string, length long, content binary")


def heads(spark: SparkSession, path: str, glob: str, n: int = 4) -> DataFrame:
    """path, length, content as audio.files() has them, but the content is the first n bytes; no more is read."""
    return _read(spark, path, glob, n)


def _known(path: str) -> bool:
    """Whether tasks can open the path by themselves: a whole one, without wildcards, in a store that pyarrow knows."""
    try:
        return not re.search(r"[*?\[{]", path) and bool(place(path))
    except (ValueError, OSError, NotImplementedError):
        return False


def texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file_id, value: whole text files below a folder. Paths that only Spark can open are read by Spark's reader."""
    if not _known(path):
        found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
        return found.select(F.input_file_name().alias("file_id"), "value")
    return _read(spark, path, glob, None).selectExpr("path AS file_id", "cast(content AS string) AS value")

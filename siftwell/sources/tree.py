"""Files as rows: folders on shared storage, and tables read as files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.contracts import ContractError, Source
from siftwell.functions.patterns import glob_regex

PYTHON_SKIP = (".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "node_modules", ".tox", "build")


def _open(scope: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a scope and the path in it: any URI that Arrow knows, or a path of this machine and its like."""
    if "://" in scope:
        return pyarrow.fs.FileSystem.from_uri(scope)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(scope.removeprefix("file:"))


def list_files(scope: str, source: Source) -> list[str]:
    """Relative paths of regular files under ``scope`` (or its own name, if it is a file) that the globs take; links are passed by.
    Skipped folders aren't entered. Raises beyond the limits on files and bytes: a file is never left out for its size."""
    take, leave = ([re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in globs] for globs in (source.include, source.exclude))
    wanted = lambda path: any(r.match(path) for r in take) and not any(r.match(path) for r in leave)
    fs, root = _open(scope)
    linked = lambda path: isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.islink(path)
    top = fs.get_file_info(root)
    if top.type == pyarrow.fs.FileType.NotFound:
        raise ContractError(f"neither file nor folder: {scope}")
    found: list[tuple[str, int]] = []
    folders = [(root, "")] if top.type == pyarrow.fs.FileType.Directory else []
    if not folders and wanted(top.base_name):
        found.append((top.base_name, top.size))
    while folders:
        folder, above = folders.pop()
        for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(folder)), key=lambda i: i.base_name):
            path = f"{above}{info.base_name}"
            if linked(info.path):
                continue
            if info.type == pyarrow.fs.FileType.Directory:
                if info.base_name not in source.skip_dirs:
                    folders.append((info.path, path + "/"))
            elif info.type == pyarrow.fs.FileType.File and wanted(path):
                found.append((path, info.size))
                if len(found) > source.limits.files:
                    raise ContractError(f"more than {source.limits.files} files")
    for path, n in found:
        if n > source.limits.file_bytes:
            raise ContractError(f"{path} has {n} bytes")
    return [path for path, _ in sorted(found, key=lambda x: x[0].split("/"))]


def read_tree(spark: SparkSession, scope: str, source: Source) -> DataFrame:
    """(source, text): names are listed on the driver (Spark's own listing hides names that begin with _ or .), texts are read on
    the executors, which must see the scope too. Unreadable or wrongly encoded files fail the read."""
    names, single = list_files(scope, source), _open(scope)[0].get_file_info(_open(scope)[1]).type == pyarrow.fs.FileType.File

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(scope)
        for pdf in batches:
            texts = []
            for name in pdf["source"]:
                with fs.open_input_stream(root if single else f"{root}/{name}") as f:
                    texts.append(f.read().decode("utf-8"))
            yield pd.DataFrame({"source": pdf["source"], "text": texts})

    listed = spark.createDataFrame([(n,) for n in names], "source string")
    return listed.repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, "source string, text string")


def table_as_files(docs: DataFrame) -> DataFrame:
    """documents as (source, text): docs/<source>/<six-digit id>.<lang>."""
    number = F.col("doc_id").cast("string")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0")), F.lit("."), "lang")
    return docs.select("doc_id", path.alias("source"), "text")

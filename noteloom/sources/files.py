"""Walks of note folders, and several inputs as one."""
from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame

# Folders that a walk does not enter.
PRUNED = frozenset(("node_modules", ".git", "target", ".rag"))


def markdown_files(root: str) -> list[str]:
    """Files with the extension md below a folder, links followed, sorted. Names may begin with a dot or an underscore, which Spark's own listing would hide. Folders on a shared or local file system only."""
    if os.path.isfile(root):
        return [root]
    if os.path.basename(os.path.normpath(root)) in PRUNED:
        return []
    found, seen = [], set()
    for folder, folders, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            folders[:] = []
            continue
        seen.add(real)
        folders[:] = sorted(d for d in folders if d not in PRUNED)
        found += [os.path.join(folder, n) for n in names if os.path.splitext(n)[1] == ".md" and n not in PRUNED]
    return sorted(found)


def plain_address(uri: str) -> str:
    """An address with one slash after its scheme, however many it has."""
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def listed(spark, paths: list[str]) -> list[tuple[str, str]]:
    """(path, address) of the files behind paths that Spark reads: patterns and folders in the order of their names, the rest as given."""
    java, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, str]] = []
    for path in paths:
        p = java.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = fs.globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            files = [s.getPath() for s in fs.listStatus(status.getPath()) if s.isFile()] if status.isDirectory() else [status.getPath()]
            out += sorted((f.toString(), plain_address(f.toUri().toString())) for f in files if not f.getName().startswith(("_", ".")) or not status.isDirectory())
    return out


def read_files(spark, paths: list[str]) -> DataFrame:
    """(file, value, input) of whole files, hidden names included, numbered in the order given, read on the executors; the folders have to be shared."""
    if not paths:
        return spark.createDataFrame([], "file string, value string, input long")

    def read(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, at in zip(frame["file"], frame["input"]):
                with open(path, encoding="utf-8", newline="") as f:
                    rows.append((path, f.read(), at))
            yield pd.DataFrame(rows, columns=["file", "value", "input"])

    names = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "file string, input long")
    return names.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInPandas(read, "file string, value string, input long")


def union(inputs: Iterable[DataFrame]) -> DataFrame:
    """All documents of several inputs; equal ones stay."""
    return reduce(DataFrame.unionByName, inputs)

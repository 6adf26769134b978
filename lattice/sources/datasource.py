"""Source trees for spark.read, and extraction for SQL."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from lattice.sources import extract, tree

#: Files that one task reads.
PER_TASK = 64


class _Paths(InputPartition):
    def __init__(self, paths: list[tuple[str, str | None, list[str]]]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[_Paths]:
        found = [(p, language := extract.language_of(p), tree.scope_of(self.root, p, language)) for p in tree.discover(self.root)]
        return [_Paths(found[i : i + PER_TASK]) for i in range(0, len(found), PER_TASK)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path, language, scope in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, language, scope, f.read()
            except OSError:
                yield path, language, scope, None


class SourceTree(DataSource):
    """spark.read.format("sourcetree").load(root): path, language, scope, content of every file, hidden ones and those that begin with _ too."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "path string, language string, scope array<string>, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


@udtf(returnType="name string, qualified_name string, kind string, start_line int, end_line int, signature string")
class ExtractSymbols:
    """SELECT * FROM extract_symbols(path, language, text): the symbols of one text."""

    def eval(self, path: str, language: str, text: str):
        if path is None or text is None or (language or extract.language_of(path)) is None:
            return
        for n in extract.extract(path, language or extract.language_of(path), [], text).nodes:
            yield n["name"], n["qualified_name"], n["kind"], n["start_line"], n["end_line"], n["signature"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.udtf.register("extract_symbols", ExtractSymbols)

"""Keeping an index up to date: one writer for a root, a change feed, a re-index for each batch of changes."""

from __future__ import annotations

import fcntl
import os
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lattice import project
from lattice.sources import tree

DEBOUNCE_MS, RETRY_S = 400, 3


def seen(root: str) -> dict[str, tuple[int, int]]:
    """Size and time of change of each file that indexing would read."""
    out = {}
    for path in tree.discover(root):
        try:
            s = os.stat(os.path.join(root, path))
            out[path] = (s.st_mtime_ns, s.st_size)
        except OSError:
            continue
    return out


class _Reader(SimpleDataSourceStreamReader):
    """Changes since the last look: added, edited and removed files. Spark's own file source misses edits and removals."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = {k: tuple(v) for k, v in start["files"].items()}, seen(self.root)
        rows = [(p, "added" if p not in before else "edited") for p, v in now.items() if before.get(p) != v]
        rows += [(p, "removed") for p in before if p not in now]
        return iter(sorted(rows)), {"files": {k: list(v) for k, v in now.items()}}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        a, b = start["files"], end["files"]
        rows = [(p, "added" if p not in a else "edited") for p, v in b.items() if a.get(p) != v] + [(p, "removed") for p in a if p not in b]
        return iter(sorted(rows))


class TreeChanges(DataSource):
    """spark.readStream.format("treechanges").load(root): rows (path, change)."""

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "path string, change string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


class Watcher:
    """Elects one writer for a root by a file lock; the writer indexes at once and after each batch of changes, the others wait to take over."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, on_reindex: Callable[[dict], None] = lambda stats: None) -> None:
        self.spark, self.root, self.folder = spark, root, folder or os.path.join(root, ".lattice")
        self.on_reindex, self.count, self.query, self.lock, self.stopped = on_reindex, 0, None, None, threading.Event()

    @property
    def state(self) -> str:
        return "writer" if self.query is not None else "standby" if not self.stopped.is_set() else "reader"

    def start(self) -> str:
        if self.query is None and self._elected():
            self._watch()
        elif self.query is None:
            threading.Thread(target=self._wait, daemon=True).start()
        return self.state

    def _elected(self) -> bool:
        os.makedirs(self.folder, exist_ok=True)
        handle = open(os.path.join(self.folder, "writer.lock"), "w")  # noqa: SIM115
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            handle.close()
            return False
        self.lock = handle
        return True

    def _wait(self) -> None:
        while not self.stopped.wait(RETRY_S):
            if self._elected():
                self._watch()
                return

    def _watch(self) -> None:
        self.spark.dataSource.register(TreeChanges)
        changes = self.spark.readStream.format("treechanges").load(self.root)

        def batch(df, _) -> None:
            if not df.isEmpty():  # many changes, one run
                stats = project.index_project(self.spark, self.root, self.folder)
                self.count += 1
                self.on_reindex(stats)

        self.query = changes.writeStream.foreachBatch(batch).trigger(processingTime=f"{DEBOUNCE_MS} milliseconds").start()

    def stop(self) -> None:
        self.stopped.set()
        if self.query is not None:
            self.query.stop()
            self.query = None
        if self.lock is not None:
            self.lock.close()
            self.lock = None

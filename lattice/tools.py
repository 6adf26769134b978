"""What an agent may call: eight tools over one root, each with text as its answer."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

from lattice import format as texts
from lattice import project
from lattice.model import NodeKind
from lattice.operators import language
from lattice.streaming.watch import Watcher


class ToolError(ValueError):
    """The call can't be answered as asked."""


def first_folder(value: str | None) -> str | None:
    """A folder as it is, else the first of a comma-separated list."""
    if not value:
        return None
    return value if os.path.isdir(value) else value.split(",")[0].strip() or None


def resolve_root(explicit: str | None = None, env: dict[str, str] | None = None) -> str:
    """The root to work on: what was asked for, LATTICE_ROOT, the host's workspace folders, the working directory; never the home folder itself."""
    env = dict(os.environ) if env is None else env
    found = explicit or env.get("LATTICE_ROOT") or first_folder(env.get("WORKSPACE_FOLDER_PATHS")) or os.getcwd()
    path = os.path.realpath(found)
    if not os.path.isdir(path):
        raise ToolError(f"{found} is no folder")
    if path == os.path.realpath(str(Path.home())):
        raise ToolError("the home folder is no project; name one")
    return path


class Tools:
    def __init__(self, spark: SparkSession, root: str, folder: str | None = None) -> None:
        self.spark, self.root, self.folder = spark, root, folder
        self.watcher: Watcher | None = None

    def _index(self) -> project.ProjectIndex:
        try:
            return project.ProjectIndex(self.spark, self.root, self.folder)
        except project.IndexMissing as e:
            raise ToolError(f"{e} (call watch)") from e

    def watch(self) -> dict:
        """Index now and after each change, or stand by where another process does. Calling it again changes nothing."""
        if self.watcher is None:
            self.watcher = Watcher(self.spark, self.root, self.folder)
            self.watcher.start()
        return {"state": self.watcher.state, "reindexed": self.watcher.count}

    def explore(self, query: str, max_bytes: int = 20_000) -> str:
        return texts.context_text(self._index().context(query, max_bytes=max_bytes))

    def search(self, query: str, limit: int = 30, kinds: tuple[str, ...] = ()) -> str:
        """Unknown kinds are left out; if none is left, all kinds count."""
        known = tuple(k for k in kinds if k in list(NodeKind))
        return texts.search_text(query, [r.asDict() for r in self._index().search_symbols(query, limit, known).collect()])

    def files(self, query: str, limit: int = 30) -> str:
        return texts.files_text(query, [r.asDict() for r in self._index().search_files(query, limit).collect()])

    def symbol(self, selector: str) -> str:
        outcome, rows = self._index().resolve_selector(selector)
        rows = [r.asDict() for r in rows]
        return texts.not_found_text(selector) if outcome == "not_found" else texts.symbol_text(rows[0]) if outcome == "matched" else texts.ambiguous_text(selector, rows)

    def _calls(self, selector: str, direction: str, depth: int, limit: int) -> str:
        index = self._index()
        outcome, rows = index.resolve_selector(selector)
        if outcome != "matched":
            shown = [r.asDict() for r in rows]
            raise ToolError(texts.not_found_text(selector) if not rows else texts.ambiguous_text(selector, shown))
        found = language.expand(index.graph, index.call_graph(f"element:{rows[0]['id']}", direction, depth, limit)).orderBy("depth", "id")
        return texts.walk_text(selector, direction, [r.asDict() for r in found.collect()])

    def callers(self, selector: str, depth: int = 2, limit: int = 50) -> str:
        return self._calls(selector, "incoming", depth, limit)

    def callees(self, selector: str, depth: int = 2, limit: int = 50) -> str:
        return self._calls(selector, "outgoing", depth, limit)

    def status(self) -> dict:
        out = project.status(self.spark, self.root, self.folder)
        return out | {"watch": self.watcher.state if self.watcher else "reader"}

    def close(self) -> None:
        if self.watcher is not None:
            self.watcher.stop()

"""Source trees: discovery with ignore rules, content hashes, scopes, and extraction on executors."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.model import REFERENCES, SYMBOLS, SYNTACTIC_EDGES
from lattice.sources import extract

# Folders that are never entered, and files whose change calls for new scopes everywhere.
SKIPPED = (".git", ".lattice", "target", "node_modules", "vendor")
# Extensions of source files, with or without an extractor.
RECOGNIZED = (
    "rs", "ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs", "py", "pyi", "go", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "cs", "php", "rb", "swift", "kt", "kts", "scala",
    "sc", "dart", "lua", "luau", "m", "mm", "pas", "dpr", "dpk", "lpr", "svelte", "vue", "liquid",
)

FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("language", T.StringType()), T.StructField("scope", T.ArrayType(T.StringType()), False)])
EXTRACTION = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("language", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("nodes", T.ArrayType(SYMBOLS)),
        T.StructField("edges", T.ArrayType(SYNTACTIC_EDGES)),
        T.StructField("references", T.ArrayType(REFERENCES)),
    ]
)


#: What extractions and snapshots are made by: rows of another form, or of extractors before a change, are never taken for current ones.
FORMAT = hashlib.sha256(f"3:{EXTRACTION.simpleString()}".encode()).hexdigest()[:16]


def unsupported(path: Column) -> Column:
    """A source file that no extractor reads."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*(x for x in RECOGNIZED if x not in extract.EXTENSIONS))


def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.lstrip("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    rooted = "/" in line
    body = "".join(".*" if part == "**" else fnmatch.translate(part)[4:-3].replace(".*", "[^/]*") if part else "" for part in re.split(r"(\*\*)", line.lstrip("/")))
    return re.compile(("" if rooted else "(?:.*/)?") + body.replace(".*/", "(?:.*/)?")), keep, folder


class Ignore:
    """The .gitignore files from the root down to a folder; the last rule that fits decides."""

    def __init__(self, rules: tuple = ()) -> None:
        self.rules = rules

    def entering(self, folder: str, base: str) -> Ignore:
        try:
            with open(os.path.join(folder, ".gitignore"), errors="replace") as f:
                own = tuple((base, *r) for r in map(_rule, f) if r)
        except OSError:
            own = ()
        return Ignore(self.rules + own)

    def hides(self, path: str, is_folder: bool) -> bool:
        out = False
        for base, pattern, keep, folder in self.rules:
            inner = path[len(base) :]
            if path.startswith(base) and (is_folder or not folder) and pattern.fullmatch(inner):
                out = not keep
        return out


def discover(root: str) -> list[str]:
    """All files below root in order of path, hidden ones too, without skipped folders and what .gitignore hides; unreadable folders are passed over."""
    found: list[str] = []

    def down(folder: str, base: str, ignore: Ignore) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        ignore = ignore.entering(folder, base)
        for e in entries:
            path = base + e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED and not ignore.hides(path, True):
                    down(e.path, path + "/", ignore)
            elif e.is_file(follow_symlinks=False) and not ignore.hides(path, False):
                found.append(path)

    down(root, "", Ignore())
    return sorted(found)


def _crate_name(root: str, path: str) -> tuple[str, str]:
    """The nearest package's name and folder for a Rust file."""
    folder = os.path.dirname(path)
    while True:
        try:
            with open(os.path.join(root, folder, "Cargo.toml")) as f:
                section = re.search(r"(?ms)^\[package\](.*?)(?=^\[|\Z)", f.read())
            name = section and re.search(r'(?m)^\s*name\s*=\s*"([^"]+)"', section[1])
            if name:
                return name[1].replace("-", "_"), folder
        except OSError:
            pass
        if not folder:
            return "crate", ""
        folder = os.path.dirname(folder)


def scope_of(root: str, path: str, language: str | None) -> list[str]:
    """The qualified segments that a file's symbols stand under."""
    stem, folder = os.path.splitext(path)[0], os.path.dirname(path)
    if language == "rust":
        crate, home = _crate_name(root, path)
        parts = [p for p in os.path.relpath(stem, home or ".").split("/") if p not in ("src", ".")]
        if parts and parts[-1] in ("lib", "main", "mod"):
            parts.pop()
        return [crate, *parts]
    if language == "go":
        up = folder
        while True:
            try:
                with open(os.path.join(root, up, "go.mod")) as f:
                    module = re.search(r"(?m)^module\s+(\S+)", f.read())
                rest = os.path.relpath(folder, up or ".") if folder != up else "."
                return [*(module[1].split("/") if module else []), *(p for p in rest.split("/") if p != ".")]
            except OSError:
                if not up:
                    return [p for p in folder.split("/") if p]
                up = os.path.dirname(up)
    parts = stem.split("/")
    if language in ("javascript", "typescript", "svelte", "vue") and parts[-1] == "index":
        parts.pop()
    if language == "python":
        top, up = folder, folder
        while up and os.path.exists(os.path.join(root, up, "__init__.py")):
            top, up = up, os.path.dirname(up)
        head = os.path.relpath(stem, os.path.dirname(top) or ".") if os.path.exists(os.path.join(root, folder, "__init__.py")) and folder else os.path.basename(stem)
        parts = head.split("/")
        if parts[-1] == "__init__":
            parts.pop()
    return parts


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, language and scope of every discovered file; the list of names is the driver's, contents stay with the executors."""
    paths = discover(root)
    rows = [(p, language := extract.language_of(p), scope_of(root, p, language)) for p in paths]
    return spark.createDataFrame(rows, FILES)


def read_contents(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for path in df["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        out.append((f.read(), None))
                except OSError as e:
                    out.append((None, str(e)))
            df = df.assign(content=[c for c, _ in out], message=[m for _, m in out])
            yield df.assign(content_hash=[hashlib.sha256(c).hexdigest() if c is not None else None for c in df["content"]])

    return run


def contents(found: DataFrame, root: str) -> DataFrame:
    schema = T.StructType([*FILES.fields, T.StructField("content", T.BinaryType()), T.StructField("message", T.StringType()), T.StructField("content_hash", T.StringType())])
    return found.repartition(found.sparkSession.sparkContext.defaultParallelism, "path").mapInPandas(read_contents(root), schema)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for r in df.itertuples():
            if r.content is None:
                rows.append((r.path, r.language, None, "failed", r.message, [], [], []))
                continue
            try:
                x = extract.extract(r.path, r.language, list(r.scope), r.content.decode(errors="replace"))
                rows.append((r.path, r.language, r.content_hash, x.status, None, x.nodes, x.edges, x.references))
            except Exception as e:  # one file's failure is a row, not the end of the run
                rows.append((r.path, r.language, r.content_hash, "failed", f"{type(e).__name__}: {e}", [], [], []))
        yield pd.DataFrame(rows, columns=EXTRACTION.names)


def extractions(read: DataFrame) -> DataFrame:
    """One row for each file in a known language, with its symbols, edges and references."""
    return read.where("language is not null").select("path", "language", "scope", "content", "message", "content_hash").mapInPandas(_extract, EXTRACTION)


def reuse(read: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Extractions of files whose path, content and scope are in the cache are taken from there; the rest are made."""
    read = read.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", F.lit(FORMAT), "path", "content_hash", F.array_join("scope", "::")), 256))
    if cache is None:
        made = extractions(read)
        return made.join(read.select("path", "cache_key"), "path")
    fresh = read.join(cache.select("cache_key"), "cache_key", "left_anti")
    made = extractions(fresh).join(fresh.select("path", "cache_key"), "path")
    return made.unionByName(cache.join(read.select("cache_key"), "cache_key", "left_semi").select(made.columns))

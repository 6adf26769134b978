"""Symbol and file search, selectors and status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.functions import text
from lattice.model import UNRESOLVED, Graph
from lattice.runtime import cut

FIELDS = ("name", "qualified_name", "kind", "signature", "docstring", "file_path")
ORDER = ("qualified_name", "file_path", "start_byte")


def symbols(elements: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Elements that are no diagnostics, of the kinds asked for; none asked for means all."""
    out = elements.where(F.col("kind") != UNRESOLVED)
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def with_words(elements: DataFrame) -> DataFrame:
    """Elements with their words and lowered fields; an index stores them so, and they aren't made again."""
    return elements if text.WORDS in elements.columns else elements.withColumns(text.prepared({f: F.col(f) for f in FIELDS}))


def without_words(elements: DataFrame) -> DataFrame:
    return elements.drop(text.WORDS, text.NAME_WORDS, *(f"low_{f}" for f in FIELDS))


def search_symbols(elements: DataFrame, query: str, limit: int = 50, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The best symbols for a query with their score. Without terms every symbol has score 0; with terms a symbol without a hit still has its bonuses, so all are scored: one scan and a top-k."""
    found = symbols(elements, kinds)
    if text.query_terms(query):
        found = with_words(found).withColumn("score", text.symbol_score(query, {f: F.col(f) for f in FIELDS}))
    else:
        found = found.withColumn("score", F.lit(0).cast("long"))
    best = without_words(found).orderBy(F.col("score").desc(), *ORDER).limit(limit)
    return best.where("score > 0") if text.query_terms(query) else best  # after the limit, where it doesn't make scores and words twice


def search_files(elements: DataFrame, query: str, limit: int = 50, top: int = 8) -> DataFrame:
    """The best files: score, number of symbols other than the file itself, and the first of them by name.

    A file is a count and a flag for each word of the query until the best are known; only their symbols are looked at again."""
    words, own = text.query_terms(query), F.col("kind") != "file"
    known = with_words(symbols(elements))
    flags = [F.max(F.array_contains(text.NAME_WORDS, w)).alias(f"has_{i}") for i, w in enumerate(words)]
    files = known.groupBy("file_path").agg(F.count_if(own).alias("symbol_count"), *flags)
    scored = files.withColumn("score", text.file_score(query, F.col("file_path"), {w: F.col(f"has_{i}") for i, w in enumerate(words)})).where("score > 0")
    best = cut(scored.select("file_path", "score", "symbol_count").orderBy(F.col("score").desc(), "file_path").limit(limit))
    names = known.where(own).join(F.broadcast(best.select("file_path")), "file_path", "left_semi").select("file_path", "qualified_name").distinct()  # limit rows at most
    n = F.row_number().over(W.partitionBy("file_path").orderBy("qualified_name"))
    first = names.withColumn("n", n).where(F.col("n") <= top).groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "qualified_name"))), lambda x: x["qualified_name"]).alias("top_symbols"))
    shown = best.join(F.broadcast(first), "file_path", "left").withColumn("top_symbols", F.coalesce("top_symbols", F.array().cast("array<string>")))
    return shown.select("file_path", "score", "symbol_count", "top_symbols").orderBy(F.col("score").desc(), "file_path")


def selector(query: str) -> tuple[Column, str]:
    """What a selector asks for, and its form: element:<id>, name:<name>, file:<path>:<line>, or a qualified name. Malformed selectors ask for nothing."""
    if query.startswith("element:"):
        number = query[8:]
        ok = re.fullmatch(r"[0-9]+", number) and int(number) < 1 << 63
        return (F.col("id") == int(number) if ok else F.lit(False)), "element"
    if query.startswith("name:"):
        return F.col("name") == query[5:], "name"
    if query.startswith("file:"):
        path, _, line = query[5:].rpartition(":")
        if not path or not re.fullmatch(r"[0-9]+", line):
            return F.lit(False), "file"
        return (F.col("kind") != "file") & (F.col("file_path") == path) & F.lit(int(line)).between(F.col("start_line"), F.col("end_line")), "file"
    return F.col("qualified_name") == query, "qualified"


def select(elements: DataFrame, query: str) -> DataFrame:
    """Symbols of a selector, by name, file and start; of a line, the one with the smallest span."""
    wanted, form = selector(query)
    found = symbols(elements).where(wanted)
    if form == "file":
        size = F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0))
        return found.orderBy(size, F.col("start_byte").desc(), "stable_key").limit(1)
    return found.orderBy(*ORDER)


class NotOne(ValueError):
    """A selector that doesn't name one symbol; candidates are those it names."""

    def __init__(self, query: str, candidates: list) -> None:
        super().__init__(f"{query!r} names {'several symbols: ' + ', '.join(f'{r['qualified_name']} [{r['id']}]' for r in candidates) if candidates else 'no symbol'}")
        self.query, self.candidates = query, candidates


def select_one(elements: DataFrame, query: str) -> tuple[str, list]:
    """("matched", [row]), ("not_found", []) or ("ambiguous", rows)."""
    rows = without_words(select(elements, query)).collect()  # symbols of one name, shown to a person
    return ("matched" if len(rows) == 1 else "ambiguous" if rows else "not_found"), rows


def the_one(elements: DataFrame, query: str) -> DataFrame:
    """The one symbol (id) of a selector; NotOne if there is none or more than one."""
    found = select(elements, query).select("id", "qualified_name")
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise NotOne(query, found.collect() if rows else [])  # symbols of one name
    return found.sparkSession.createDataFrame([(rows[0]["id"],)], "id long")


def status(graph: Graph) -> DataFrame:
    """Counts of what is stored, one row."""
    e = graph.elements.agg(F.count("*").alias("elements"), F.count_if(F.col("kind") == UNRESOLVED).alias("unresolved"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_distinct("file_path").alias("files"))
    r = graph.relations.agg(F.count("*").alias("relations"), F.count_if(F.col("kind") == "calls").alias("calls"))
    i = graph.incidences.agg(F.count("*").alias("incidences")) if graph.incidences is not None else graph.relations.sparkSession.range(1).select(F.lit(0).cast("long").alias("incidences"))
    return e.join(F.broadcast(r)).join(F.broadcast(i))  # three tables of one row each

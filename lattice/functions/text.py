"""Search terms, ranking scores, previews and names."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a test, what asks for tests, and the points of a search.
TEST_FOLDERS = ("tests", "benches", "examples", "fixtures", "__tests__")
TEST_WORDS = ("test", "tests", "bench", "benches", "example", "examples", "fixture", "fixtures")
TEST_NAMES = r"_test\.(go|py)$|(^|/)test_[^/]*\.py$|\.(test|spec)\.([^/]*\.)?([jt]sx?|[mc][jt]s)$"
KIND_POINTS = {"function": 220, "method": 220, "trait": 160, "struct": 160, "enum": 160, "type_alias": 80, "constant": 80, "macro": 80, "module": 15, "impl_block": 5, "file": 0}
OTHER_KIND = 30


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, nothing else; lower() does the same where all is ASCII, and is much faster."""
    return _lowered(c, _beyond_ascii(c))


def _beyond_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def _lowered(c: Column, odd: Column) -> Column:
    return F.when(odd, F.translate(c, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(c))


def terms(c: Column) -> Column:
    """Sorted distinct ASCII words of two characters or more, split at case and digit changes to a capital."""
    return F.array_sort(_words(F.coalesce(c, F.lit(""))))


def _words(c: Column) -> Column:
    """terms() in the order of the text. Whole texts are lowered, then split."""
    parts = F.split(_lowered(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), _beyond_ascii(c)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 1))


def query_terms(query: str) -> list[str]:
    """terms() of a string on the driver."""
    split = re.split("[^A-Za-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query))
    return sorted({w.lower() for w in split if len(w) > 1})


def wants_tests(words: list[str]) -> bool:
    return any(w in TEST_WORDS for w in words)


def test_like(path: Column) -> Column:
    folders = "|".join(TEST_FOLDERS)
    return path.rlike(f"(^|/)({folders})/") | path.rlike(TEST_NAMES)


def kind_points(kind: Column) -> Column:
    out = F.lit(OTHER_KIND)
    for k, n in KIND_POINTS.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def path_points(path: Column, asked: bool) -> Column:
    test = test_like(path)
    plain = F.when(path.startswith("src/") | path.contains("/src/"), 120).when(test & F.lit(asked), 30).otherwise(60)
    return F.when(test & F.lit(not asked), 0).otherwise(plain)


#: Columns that searches read again and again; they are stored with the elements when those are indexed.
WORDS, NAME_WORDS = "search_words", "name_words"


def prepared(e: dict[str, Column]) -> dict[str, Column]:
    """The words of all fields, those of the two names, and the lowered fields."""
    every = F.concat_ws("\n", *e.values())  # no word goes over the end of a line
    low = {f"low_{k}": _lowered(F.coalesce(v, F.lit("")), _beyond_ascii(every)) for k, v in e.items()}
    return {WORDS: _words(every), NAME_WORDS: _words(F.concat_ws("\n", e["name"], e["qualified_name"]))} | low


def symbol_score(query: str, e: dict[str, Column]) -> Column:
    """Points of a symbol with prepared() columns for a query; e has name, qualified_name, kind, signature, docstring, file_path."""
    words, asked = query_terms(query), wants_tests(query_terms(query))
    low, bag = {k: F.col(f"low_{k}") for k in e}, F.col(WORDS)
    whole = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query.strip())
    hit = lambda w, field: F.array_contains(bag, w) | low[field].contains(w)
    score = F.when(low["qualified_name"] == whole, 2000).otherwise(0) + F.when(low["name"] == whole, 1800).otherwise(0)
    every = lambda field: F.lit(True) if not words else _all([hit(w, field) for w in words])
    score = score + F.when(every("qualified_name"), 900).otherwise(0) + F.when(every("name"), 800).otherwise(0)
    for w in words:
        score = score + F.when(hit(w, "name"), 160).otherwise(0) + F.when(hit(w, "qualified_name"), 130).otherwise(0)
        for field, points in (("kind", 45), ("signature", 75), ("docstring", 55), ("file_path", 20)):
            score = score + F.when(low[field].contains(w), points).otherwise(0)
    score = (score + kind_points(e["kind"]) + path_points(e["file_path"], asked)).cast("long")
    score = F.when(test_like(e["file_path"]) & F.lit(not asked), F.floor(score / 3)).otherwise(score)
    return F.when(e["kind"].isin("file", "module", "impl_block"), F.floor(score / 2)).otherwise(score).cast("long")


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def file_score(query: str, path: Column, has: dict[str, Column]) -> Column:
    """Points of a file: its path's words, parts of its path, and its symbols' words; has: for each word whether a symbol of the file has it."""
    words, asked = query_terms(query), wants_tests(query_terms(query))
    own, low = terms(path), ascii_lower(path)
    score = path_points(path, asked)
    for w in words:
        score = score + F.when(F.array_contains(own, w), 160).otherwise(0) + F.when(low.contains(w), 100).otherwise(0) + F.when(has[w], 80).otherwise(0)
    return score.cast("long")


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bounded(c: Column, n: int) -> Column:
    """The first n characters without blanks around, or null."""
    return F.nullif(F.substring(F.trim(c), 1, n), F.lit(""))


def signature(c: Column) -> Column:
    """What stands before the body, on one line, of 300 characters at most."""
    return bounded(compact(F.substring_index(F.substring_index(c, "{", 1), ";", 1)), 300)


def preview(c: Column) -> Column:
    """24 lines from the first that isn't blank, of 1200 characters at most."""
    lines = F.split(F.regexp_replace(c, r"^(\s*\n)+", ""), "\n")
    return F.substring(F.array_join(F.slice(lines, 1, 24), "\n"), 1, 1200)


def qualify(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "::")


def clean_path(c: Column) -> Column:
    """Segments of a written path without raw marks, macro marks, semicolons and blanks."""
    return F.filter(F.split(F.regexp_replace(c, r"\s+|r#|!|;", ""), "::|\\."), lambda x: x != "")


def enclosing(qualified: Column) -> Column:
    """The enclosing scopes of a qualified name, longest first."""
    parts = F.split(qualified, "::")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))).otherwise(F.array().cast("array<string>"))


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def composite_key(*parts: Column) -> Column:
    """An injective key: each part with its length before it."""
    return F.concat(*(F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts))


def location(path: Column, line: Column, column: Column, end_line: Column, end_column: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(":"), column.cast("string"), F.lit("-"), end_line.cast("string"), F.lit(":"), end_column.cast("string"))

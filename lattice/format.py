"""Reports as text for people and agents; every list is one that a report has bounded."""

from __future__ import annotations

ONE_LINE = 240


def one_line(text: str | None, n: int = ONE_LINE) -> str:
    return " ".join((text or "").split())[:n]


def inline(symbol: dict) -> str:
    return f"{symbol['kind']} {symbol['qualified_name']} [{symbol['id']}] {symbol['file_path']}:{symbol.get('start_line', '?')}"


def _details(symbol: dict) -> list[str]:
    return [f"  {name}: {one_line(symbol[key])}" for name, key in (("signature", "signature"), ("doc", "docstring")) if symbol.get(key)]


def symbol_text(symbol: dict) -> str:
    return "\n".join([inline(symbol), *_details(symbol)]) + "\n"


def search_text(query: str, matches: list[dict]) -> str:
    if not matches:
        return f"no symbols for {query!r}\n"
    return "\n".join(line for m in matches for line in (f"{inline(m)} score {m['score']}", *_details(m))) + "\n"


def files_text(query: str, files: list[dict]) -> str:
    if not files:
        return f"no files for {query!r}\n"
    return "\n".join(line for f in files for line in (f"{f['file_path']} score {f['score']}, {f['symbol_count']} symbols", *(f"  {s}" for s in f["top_symbols"]))) + "\n"


def walk_text(seed: str, direction: str, found: list[dict]) -> str:
    return "\n".join([f"{direction} from {seed}", *(f"{'  ' * f['depth']}{f['depth']} {inline(f)}" for f in found)]) + "\n"


def ambiguous_text(selector: str, matches: list[dict]) -> str:
    return "\n".join([f"{selector} stands for {len(matches)} symbols; name one by element:<id>", *(f"  {inline(m)}" for m in matches)]) + "\n"


def not_found_text(selector: str) -> str:
    return f"no symbol {selector}\n"


def context_text(report: dict) -> str:
    b = report["budget"]
    names = {s["id"]: s["qualified_name"] for s in report["symbols"]}
    name = lambda i: names.get(i, str(i))
    out = [f"context for {report['query']!r}: {len(report['symbols'])} symbols, {b['used']} of {b['max_bytes']} bytes" + (", cut" if b["truncated"] else "")]
    out += [f["text"].rstrip("\n") for f in report["files"]]
    for title, rows in (
        ("relations", [f"{name(r['source_id'])} {r['kind']} {name(r['target_id'])}" for r in report["relationships"]]),
        ("packages", [f"{r['source']} -> {r['target']}" for r in report["dependencies"]]),
        ("callers", [f"{r['qualified_name']}{' (test)' if r['is_test'] else ''}" for r in report["blast_radius"]]),
        ("flow", [" -> ".join(map(name, report["call_flow"]))] if report["call_flow"] else []),
    ):
        if rows:
            out += [f"{title}:", *(f"  {r}" for r in rows)]
    return "\n".join(out) + "\n"


def values_text(rows: list[tuple]) -> str:
    """One tab-separated line for each row."""
    return "".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows)

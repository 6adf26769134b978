"""Vocabularies and record types of the code graph."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class NodeKind(StrEnum):
    FILE = "file"
    MODULE = "module"
    NAMESPACE = "namespace"
    PACKAGE = "package"
    CLASS = "class"
    STRUCT = "struct"
    ENUM = "enum"
    TRAIT = "trait"
    INTERFACE = "interface"
    IMPL_BLOCK = "impl_block"
    FUNCTION = "function"
    METHOD = "method"
    FIELD = "field"
    VARIABLE = "variable"
    CONSTANT = "constant"
    TYPE_ALIAS = "type_alias"
    MACRO = "macro"


#: The kind of diagnostics; not a symbol.
UNRESOLVED = "unresolved_reference"


class EdgeKind(StrEnum):
    CONTAINS = "contains"
    IMPORTS = "imports"
    CALLS = "calls"
    REFERENCES = "references"
    IMPLEMENTS = "implements"
    DEFINES = "defines"
    IMPLEMENTS_FOR = "implements_for"
    DEPENDS_ON = "depends_on"


class HyperedgeKind(StrEnum):
    IMPL_GROUP = "impl_group"
    MEMBERSHIP = "membership"


class Role(StrEnum):
    ANCHOR = "anchor"
    MEMBER = "member"
    IMPL_TYPE = "impl_type"
    IMPL_TRAIT = "impl_trait"


class Direction(StrEnum):
    OUTGOING = "outgoing"
    INCOMING = "incoming"
    BOTH = "both"


class Resolution(StrEnum):
    EXACT = "exact"
    SCOPED = "scoped"
    IMPORT = "import"
    RECEIVER = "receiver"
    SIMPLE = "simple"
    AMBIGUOUS = "ambiguous"


class ParseStatus(StrEnum):
    OK = "ok"
    PARTIAL = "partial"
    FAILED = "failed"


#: Kinds that answer a context query's words.
PREFERRED = (NodeKind.FUNCTION, NodeKind.METHOD, NodeKind.TRAIT, NodeKind.STRUCT, NodeKind.ENUM, NodeKind.TYPE_ALIAS, NodeKind.CONSTANT, NodeKind.MACRO)
#: Kinds that hold others.
CONTAINERS = (NodeKind.FILE, NodeKind.MODULE, NodeKind.NAMESPACE, NodeKind.PACKAGE)
#: Edges and resolutions sure enough to become dependencies of files, modules and packages.
LIFTED_EDGES = (EdgeKind.CALLS, EdgeKind.IMPORTS, EdgeKind.REFERENCES, EdgeKind.IMPLEMENTS, EdgeKind.IMPLEMENTS_FOR)
SURE = (Resolution.EXACT, Resolution.SCOPED, Resolution.IMPORT, Resolution.RECEIVER)
#: Edges that ranking walks along.
EXPLORED = tuple(k for k in EdgeKind if k not in (EdgeKind.CONTAINS, EdgeKind.DEPENDS_ON))

SPAN = ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")
_string, _long = T.StringType(), T.LongType()


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n.rstrip("?"), T.ArrayType(_string) if k == "list" else _long if k == "long" else _string, n.endswith("?")) for n, _, k in (x.strip().partition(" ") for x in text.split(","))])


SYMBOLS = _struct("stable_key text, name text, qualified_name text, kind text, raw_kind? text, language text, file_path text, " + ", ".join(f"{s} long" for s in SPAN) + ", signature? text, docstring? text, source_preview? text")
SYNTACTIC_EDGES = _struct("source_key text, target_key text, kind text")
REFERENCES = _struct("source_key text, raw text, path list, qualifier? text, kind_hint text, kind text, file_path text, " + ", ".join(f"{s} long" for s in SPAN) + ", text text")


@dataclass(frozen=True)
class Graph:
    """The tables that reading operators work on.

    elements: id, kind, name, qualified_name, file_path, language, start_line, end_line, start_byte, end_byte, signature, docstring, stable_key.
    relations: id, source_id, target_id, kind, resolution, site_line, site_text.
    hyperedges: id, kind. incidences: relation_id, element_id, role."""

    elements: DataFrame
    relations: DataFrame
    hyperedges: DataFrame | None = None
    incidences: DataFrame | None = None


def projection_name(kind: str) -> str:
    return "calls" if kind == EdgeKind.CALLS else f"edges_{kind}"


def catalog_sizes() -> dict[str, int]:
    return {
        "roles": 2 + len(Role),
        "labels": len(NodeKind) + 1,
        "relation_types": len(EdgeKind) + len(HyperedgeKind),
        "property_keys": 23 + 12,
        "projections": len(EdgeKind) + 2,
        "indexes": 6 + 3,
    }

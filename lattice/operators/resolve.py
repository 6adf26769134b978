"""References to symbols: five tiers, ambiguity, what stays unresolved; the architecture above files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.functions import text
from lattice.model import CONTAINERS, LIFTED_EDGES, SURE
from lattice.runtime import cut, dealt

TIERS = ("exact", "scoped", "import", "receiver", "simple")


def import_map(imports: DataFrame) -> DataFrame:
    """The first import of each local name of a file; imports: file_path, local_name, path, ref_id."""
    return imports.groupBy("file_path", "local_name").agg(F.min_by("path", F.struct("ref_id", "path")).alias("base"))


def asked(refs: DataFrame, known: DataFrame) -> DataFrame:
    """What a reference may mean, before its names are written out: ref_id, source_id, scope, joined, owner, imported, bare. known: import_map()."""
    bare = F.element_at("path", -1)
    owner = F.when(F.col("qualifier").isNotNull(), text.last_segment(F.col("qualifier"))).when(F.size("path") > 1, F.get("path", F.size("path") - 2))
    imported = F.when(F.col("base").isNotNull(), F.array_join(F.concat("base", F.slice("path", 2, 1000)), "::"))
    known = known.select(F.col("file_path").alias("f"), "local_name", "base")
    with_imports = refs.join(known, (F.col("file_path") == F.col("f")) & (F.get("path", F.lit(0)) == F.col("local_name")), "left")
    return with_imports.select("ref_id", "source_id", F.when(F.col("source_name").contains("::"), _start(F.col("source_name"), _segments(F.col("source_name")) - 1)).alias("scope"), F.array_join("path", "::").alias("joined"), owner.alias("owner"), imported.alias("imported"), bare.alias("bare"))


#: Where a name is looked up: whole names, owner and member, bare names.
WHOLE, OWNED, BARE = range(3)
#: Levels of a tier; a deeper scope comes first within its tier.
DEPTHS = 1 << 16


def _odd(c: Column) -> Column:
    """Whether it matters from which end "::" is looked for; where not, strings are cut instead of arrays of their parts, which is much faster."""
    return c.contains(":::")


def _segments(c: Column) -> Column:
    return F.when(_odd(c), F.size(F.split(c, "::"))).otherwise(((F.length(c) - F.length(F.replace(c, F.lit("::"), F.lit("")))) / 2).cast("int") + 1)


def _start(c: Column, n: Column) -> Column:
    """The first n segments."""
    return F.when(_odd(c), F.array_join(F.slice(F.split(c, "::"), F.lit(1), n), "::")).otherwise(F.call_function("substring_index", c, F.lit("::"), n))


def _end(c: Column, n: int) -> Column:
    """The last n segments of at least as many."""
    return F.when(_odd(c), F.array_join(F.slice(F.split(c, "::"), -n, n), "::")).otherwise(F.substring_index(c, "::", -n))


def _bit(hash: Column) -> Column:
    """One of 64 bits of a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hash, F.lit(64)).cast("int"))


def _keys_held() -> list[tuple[int, Column]]:
    """Of an element at one last segment: its names (space, key) that end in it, null for others."""
    q, here = F.col("qualified_name"), F.col("at") == _end(F.col("qualified_name"), 1)
    return [(WHOLE, F.when(here, q)), (OWNED, F.when(here & q.contains("::"), _end(q, 2))), (BARE, F.when(F.col("at") == F.col("name"), F.col("name")))]


def _names() -> tuple[Column, Column, Column]:
    """Of a row at slot n: (space, key, level), of an element its n-th name, of a row of asked() first the whole name, import, owner and member, and bare name, then scopes from the deepest. The key is null where there is none."""
    n, here, held = F.col("slot"), F.col("at") == F.col("bare"), _keys_held()
    depth = n - 4
    scoped = F.concat(_start(F.col("scope"), F.col("scopes") - depth), F.lit("::"), "joined")
    asked = F.when(n == 1, F.when(F.col("at") == _end(F.col("imported"), 1), F.col("imported"))).when(here, F.when(n == 0, F.col("joined")).when(n == 2, F.concat("owner", F.lit("::"), "bare")).when(n == 3, F.col("bare")).otherwise(scoped))
    key = F.when(F.col("is_ref"), asked).when(n == 0, held[0][1]).when(n == 1, held[1][1]).otherwise(held[2][1])
    space = F.when(F.col("is_ref"), F.when(n == 2, OWNED).when(n == 3, BARE).otherwise(WHOLE)).otherwise(n)
    level = F.when(F.col("is_ref"), F.when(n == 0, 0).when(n < 4, (n + 1) * DEPTHS).otherwise(DEPTHS + depth))
    return space.alias("space"), key.alias("key"), level.alias("level")


def _places(elements: DataFrame) -> DataFrame:
    """Elements at the segments that their names end in."""
    last = _end(F.col("qualified_name"), 1)
    at = F.explode(F.array(last, F.when(~last.eqNullSafe(F.col("name")), F.col("name"))))
    return elements.where("id is not null").select("id", "qualified_name", "name", at.alias("at")).where("at is not null")


def looked_up(refs: DataFrame, imports: DataFrame, elements: DataFrame, value: Column | None = None, lost: bool = False) -> DataFrame:
    """One row for each reference that means something (with lost, for those that mean nothing too, of level null): ref_id, source_id, level, space, hash, low, high, targets, total.

    low and high are the least and the greatest id of the symbols of the name that wins, targets their number, total the sum of value over them; so references to a name that many symbols share stay one row each.

    All names of a reference end in one segment, as the whole and owned names of a symbol do. Both are dealt out by that segment before their names are written out, so names are compared, and the first is taken, where they are; only an import under another name brings its reference to two places. Of the names of a reference, those are written out whose bit is among the bits of the names held at its place; whole names are compared then. Segments of a path hold no "::"."""
    known = cut(import_map(imports))
    renamed = not known.where(_end(F.array_join("base", "::"), 1) != F.col("local_name")).isEmpty()
    refs = refs.where(F.size("path") > 0).join(elements.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    mine = asked(refs, known)
    ends = F.explode(F.array("bare", F.when(_end(F.col("imported"), 1) != F.col("bare"), _end(F.col("imported"), 1)))) if renamed else F.col("bare")
    mine = mine.withColumns({"at": ends, "is_ref": F.lit(True)}).where("at is not null")
    both = mine.unionByName(_places(elements).withColumn("is_ref", F.lit(False)), allowMissingColumns=True).withColumn("place", F.xxhash64("at"))
    both = dealt(both, "place")
    there = W.partitionBy("place")
    bits = [F.when(k.isNotNull(), _bit(F.xxhash64(F.lit(s), k))).otherwise(F.lit(0).cast("long")) for s, k in _keys_held()]
    both = both.withColumns({"held": F.bit_or(F.when(~F.col("is_ref"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]))).over(there), "sought": F.max("is_ref").over(there), "scopes": F.coalesce(_segments(F.col("scope")), F.lit(0))})
    slots = both.where("sought").withColumn("slot", F.explode(F.sequence(F.lit(0), F.when(F.col("is_ref"), 3 + F.col("scopes")).otherwise(2))))
    names = slots.select("place", "ref_id", "source_id", "id", "held", F.inline(F.array(F.struct(*_names()))))  # a list of one, so that filters of a key don't make it again
    names = names.where("key is not null").withColumn("hash", F.xxhash64("space", "key"))
    held = F.col("level").isNull() | (F.col("held").bitwiseAND(_bit(F.col("hash"))) != 0)
    names = names.where(held | (F.col("level") == 0) if lost else held).drop("held")
    same = W.partitionBy("hash", "place", "space", "key")
    of = {"low": F.min("id").over(same), "high": F.max("id").over(same)}
    if value is not None:
        names = names.withColumn("fresh", F.col("id").isNotNull() & ~F.col("id").eqNullSafe(F.lag("id").over(same.orderBy("id"))))
        of |= {"targets": F.count_if("fresh").over(same), "total": F.sum(F.when(F.col("fresh"), value)).over(same)}
    hits = names.withColumns(of).where("level is not null")
    level = F.when(F.col("low").isNotNull(), F.col("level"))
    hits = hits.where("low is not null or level = 0" if lost else "low is not null").withColumn("level", level)
    kept = ["space", "hash", *of]
    first = lambda df, *by: df.groupBy(*by).agg(F.min("level").alias("least"), *(F.min_by(c, "level").alias(c) for c in kept)).withColumnRenamed("least", "level")
    found = first(hits, "place", "ref_id", "source_id").drop("place")
    return first(found, "ref_id", "source_id") if renamed else found


def _resolution() -> Column:
    return F.when(F.col("low") != F.col("high"), "ambiguous").otherwise(F.element_at(F.array(*map(F.lit, TIERS)), (F.col("level") / DEPTHS).cast("int") + 1))


def resolve(refs: DataFrame, imports: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved). refs: ref_id, source_id, source_name, file_path, path, qualifier; a ref_id is one reference.

    The first tier with a target wins, several targets are ambiguous and all kept: references are looked up first, one row each, and only ambiguous ones are then joined with the symbols of their name.

    resolved: ref_id, source_id, target_id, resolution. unresolved: ref_id, source_id, reason."""
    found = looked_up(refs, imports, elements, lost=True)
    found = cut(found.select("ref_id", "source_id", "low", "high", "space", "hash", F.when(F.col("level").isNotNull(), _resolution()).alias("resolution")))
    sure = found.where("resolution <> 'ambiguous'").select("ref_id", "source_id", F.col("low").alias("target_id"), "resolution")
    names = _places(elements).withColumn("name_held", F.explode(F.array(*(F.when(k.isNotNull(), F.struct(F.lit(s).alias("space"), k.alias("key"))) for s, k in _keys_held())))).where("name_held is not null")
    names = names.select("id", "name_held.*").withColumn("hash", F.xxhash64("space", "key"))
    same = W.partitionBy("hash", "space", "key")
    names = names.select("space", "hash", F.min("id").over(same).alias("low"), F.max("id").over(same).alias("high"), F.col("id").alias("target_id")).where("low <> high").distinct()
    several = found.where("resolution = 'ambiguous'").drop("resolution").join(names, ["space", "hash", "low", "high"])  # with the least id of a name in its space, it is that name
    several = several.select("ref_id", "source_id", "target_id", F.lit("ambiguous").alias("resolution"))
    return sure.unionByName(several), found.where("resolution is null").select("ref_id", "source_id", F.lit("no matching symbol").alias("reason"))


def resolved_counts(refs: DataFrame, imports: DataFrame, elements: DataFrame, value: Column) -> DataFrame:
    """For each resolution: resolution, n (pairs of reference and target), refs, total (value of the targets, a column of id, summed over the pairs). Pairs are counted by name and never made."""
    found = looked_up(refs, imports, elements, value)
    return found.groupBy(_resolution().alias("resolution")).agg(F.sum("targets").alias("n"), F.count("*").alias("refs"), F.sum("total").alias("total"))


def container_spine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and modules above library files, and the edges package, module, file. files: stable_key, qualified_name, file_path."""
    library = files.where(F.array_contains(F.split("file_path", "/"), "src") & (F.col("qualified_name") != ""))
    parts = F.filter(F.split("qualified_name", "::"), lambda x: x != "")
    depth = F.explode(F.sequence(F.lit(1), F.size("parts")))
    levels = library.withColumn("parts", parts).where("size(parts) > 0").withColumn("depth", depth)
    name = F.array_join(F.slice("parts", 1, F.col("depth")), "::")
    levels = levels.withColumn("name", name).withColumn("key", F.concat(F.when(F.col("depth") == 1, "package:").otherwise("module:"), "name"))
    nodes = levels.groupBy("key").agg(F.first("name").alias("qualified_name"), F.when(F.min("depth") == 1, "package").otherwise("module").alias("kind"), F.min(F.struct(F.size("parts") != F.col("depth"), "file_path")).getField("file_path").alias("file_path"))
    above = F.array_join(F.slice("parts", 1, F.col("depth") - 1), "::")
    steps = levels.where("depth > 1").select(F.concat(F.when(F.col("depth") == 2, "package:").otherwise("module:"), above).alias("source_key"), F.col("key").alias("target_key"))
    last = levels.where("depth = size(parts)").select(F.col("key").alias("source_key"), F.col("stable_key").alias("target_key"))
    return nodes, steps.union(last).distinct()


def lift_dependencies(edges: DataFrame, containers: DataFrame) -> DataFrame:
    """depends_on edges between the containers of sure edges' ends, at each level, without those within one container.

    edges: source_id, target_id, kind, resolution; containers: id, levels (array of container ids, one for each level). Edges are reduced to distinct pairs of containers before anything else is done with them."""
    sure = edges.where(F.col("kind").isin(*LIFTED_EDGES) & F.col("resolution").isin(*SURE))
    a, b = containers.select(F.col("id").alias("source_id"), F.col("levels").alias("x")), containers.select(F.col("id").alias("target_id"), F.col("levels").alias("y"))
    pairs = sure.join(a, "source_id").join(b, "target_id").select("x", "y").distinct()
    return pairs.select(F.inline(F.arrays_zip(F.col("x").alias("source_id"), F.col("y").alias("target_id")))).where("source_id <> target_id").distinct()


def membership(contains: DataFrame, elements: DataFrame) -> DataFrame:
    """One row for each container with its members: anchor_id, members (sorted), size. contains: source_id, target_id."""
    anchors = elements.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source_id"))
    return contains.join(anchors, "source_id", "left_semi").groupBy(F.col("source_id").alias("anchor_id")).agg(F.sort_array(F.collect_set("target_id")).alias("members")).withColumn("size", F.size("members"))


def hyperedge_groups(participants: DataFrame) -> DataFrame:
    """Hyperedges of participants (relation_id, element_id, role): distinct, in order, and none that has only its anchor."""
    grouped = participants.groupBy("relation_id").agg(F.sort_array(F.collect_set(F.struct("role", "element_id"))).alias("participants"))
    return grouped.where("size(participants) > 1")

"""Exact deduplication through recipes of content-defined chunks; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.llm.common import cut

#: A chunk ends where the text itself says so (a vowel, a consonant, e, space), after 256 to 2048 characters.
CHUNK = r"(?s).{256,2048}?(?:[aeiou][b-df-hj-np-tv-z]e |\z)|.{1,2048}"
#: A character other than ASCII and the small or caseless half of Latin-1.
OTHER = r"[^\x00-\xBF\xDF-\xFF]"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else; lower() does the same where no other letter has a capital form."""
    return F.when(text.rlike(OTHER), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal after lowering A-Z.

    Each text becomes a recipe, the ordered hashes of its chunks; only recipes are grouped. Where a recipe occurs more than once, the chunks of those texts are reduced to distinct contents, which verifies that a hash stands for one content; a hash with more contents gets a number for each, and recipes carry it. Texts with equal verified recipes are equal, and no long text is moved for each comparison.

    Returns (id, keep_id, group_size, kept, text_sha256) for each row: keep_id is the largest id of the group, and rows with it are kept. Null counts as empty. Rows that repeat id and text are all kept or all dropped. A null id is kept only if its group has no other. An empty table gives an empty result. Other columns are not read."""
    docs = df.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    recipe = F.transform(chunks(F.col("text")), lambda c: F.xxhash64(c, F.length(c)))
    recipes = docs.select("id", recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    recipes = cut(recipes.withColumn("mark", F.xxhash64("recipe", F.size("recipe"))))
    # written out, so that the joins with it can be split where one group has a large share of the rows
    often = cut(recipes.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), recipes.count())
    copies = recipes.join(often, "mark", "left_semi")
    asked = copies.select("id").distinct()
    met = docs.join(asked, docs["id"].eqNullSafe(asked["id"]), "left_semi").select(F.explode(chunks(F.col("text"))).alias("chunk"))
    contents = met.select(F.xxhash64("chunk", F.length("chunk")).alias("h"), "chunk").distinct()
    clashes = cut(contents.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), 0)  # none, but for a chance of one in 2 ** 64
    if not clashes.isEmpty():
        recipes = _numbered(docs, recipes, contents, clashes)
    else:
        recipes = recipes.withColumn("numbers", F.array().cast("array<int>"))
    groups = recipes.groupBy("mark", "recipe", "numbers").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    many = cut(groups.where("group_size > 1").select(F.col("mark").alias("m"), F.col("recipe").alias("r"), F.col("numbers").alias("k"), "keep_id", "group_size"), recipes.count())
    same = (F.col("mark") == F.col("m")) & (F.col("recipe") == F.col("r")) & (F.col("numbers") == F.col("k"))
    out = recipes.join(many, same, "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _numbered(docs: DataFrame, recipes: DataFrame, contents: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes with the number of each clashing chunk's content, in order."""
    numbers = contents.join(clashes, "h", "left_semi").withColumn("number", F.row_number().over(W.partitionBy("h").orderBy("chunk")))
    spread = docs.select("id", F.sha2("text", 256).alias("sha"), F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).withColumn("h", F.xxhash64("chunk", F.length("chunk")))
    told = spread.join(numbers, ["h", "chunk"]).groupBy("id", "sha").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("at", "number")))).alias("told"))
    told = told.select(F.col("id").alias("i"), F.col("sha").alias("s"), F.transform("told", lambda x: x["number"]).alias("numbers"))
    joined = recipes.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("s")), "left")
    return joined.select(*recipes.columns, F.coalesce("numbers", F.array().cast("array<int>")).alias("numbers"))

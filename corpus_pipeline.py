"""From raw documents to packed sequences: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import common, exact, jaccard, mixing, packing, quality


def _free(docs: DataFrame, stem: str) -> str:
    """A name that no column of docs has."""
    own = {c.lower() for c in docs.columns}
    return next(n for n in (f"{stem}{i or ''}" for i in range(len(own) + 1)) if n not in own)


def _without(docs: DataFrame, dropped: DataFrame, key) -> DataFrame:
    """docs without the rows whose id and key(text) are in dropped (id, mark); a null id is an id like others."""
    gone = dropped.select("id", "mark").distinct().alias("gone")
    same = F.col("d.doc_id").eqNullSafe(F.col("gone.id")) & (key(F.col("d.text")) == F.col("gone.mark"))
    return docs.alias("d").join(gone, same, "left_anti").select("d.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the quality classifier doesn't reject: those scored 0.3 or more.

    Each row is judged by its own whole text, however long, so rows that repeat fare alike, and rows of one id may fare differently. A null or empty text has the score of the bias alone; a null id is scored like any other. Without labels every score is 0.5 and all rows stay. All columns of docs are returned as they were, others than those of documents included; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit_named(docs, labels)
    name = _free(docs, "score")
    return quality.score(docs, weights, score_col=name).where(F.col(name) >= quality.THRESHOLD).select(docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lowering A-Z, the rows with the largest id.

    A decision is a row's, by id and text: a unique text stays though another text of its id is dropped. Null and empty texts are equal; of them too the largest id stays. A null id is smaller than any other. Rows with the same id and equal texts are all kept or all dropped. Texts are compared whole. All columns of docs are returned as they were; an empty table stays empty."""
    dropped = exact.exact_dedup(docs).where("not kept").select("id", F.col("text_sha256").alias("mark"))
    return _without(docs, dropped, lambda text: F.sha2(exact.ascii_lower(F.coalesce(text, F.lit(""))), 256))


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 80 %), the rows with the smallest id.

    A decision is a row's, by id and text. Null, empty and wordless texts are near nothing and stay. A row without an id stays. An id is one document: where rows of one id have different texts, the groups of those texts are one group. Rows with the same id and text are all kept or all dropped. Texts are compared whole. All columns of docs are returned as they were; an empty table stays empty."""
    found, _ = jaccard.jaccard_join(docs)
    return _without(docs, found.where("id <> component_id").select("id", F.col("text_key").alias("mark")), common.text_key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of docs as often as the mix takes it; where a source's budget ends, the last text is cut after the words taken.

    What is taken is a row's own number, by id, source and text, null ids and sources being values like others; rows that are alike in all three are each taken as often as the one of them that is taken most. Null, empty and wordless texts have no words to take and are left out. The columns of docs are returned, with text and, where there is one, n_chars changed for a text that is cut; an empty table stays empty."""
    taken = mixing.mix(docs, mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("taken > 0")
    taken = taken.groupBy("id", "source", "text_key").agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    mix, part = _free(docs, "mix"), _free(docs, "part")
    taken = taken.select(F.struct("id", "source", "text_key", "size", "taken").alias(mix))
    same = F.col("d.doc_id").eqNullSafe(F.col(f"{mix}.id")) & F.col("d.source").eqNullSafe(F.col(f"{mix}.source")) & (common.text_key(F.col("d.text")) == F.col(f"{mix}.text_key"))
    size, number = F.col(f"{mix}.size"), F.col(f"{mix}.taken")
    every = F.transform(F.sequence(F.lit(0), ((number - 1) / size).cast("int")), lambda i: F.struct(F.least(size, number - i * size).alias("left"), size.alias("size")))
    times = docs.alias("d").join(taken, same).select("d.*", F.explode(every).alias(part))
    left = F.col(f"{part}.left")
    cut_text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + mixing.WORDS), F.lit(0)), 1, left.cast("int")), "")
    shorter = left < F.col(f"{part}.size")
    text = F.when(shorter, cut_text).otherwise(F.col("text"))
    now = {"text": text} | ({"n_chars": F.when(shorter, F.length(cut_text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return times.select(*(now.get(c, F.col(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row of docs goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one end token; a long one is cut into pieces of 2048. Null ids stay null; rows that repeat are packed each. Columns other than doc_id and text are not read; an empty table gives an empty result."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", good), ("exact dedup", distinct_texts), ("n-gram Jaccard join", distinct_groups), ("mixing sources", mixed), ("best-fit packing", packed)]
#: Shingle sets, hashed features and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

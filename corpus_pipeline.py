"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.llm import decontaminate, near_dedup, pieces, pii, quality_hosts
from voxweave.runtime import cut, ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, the further rules or their host's failure rates reject go."""
    verdict = quality_hosts.judge(docs)
    return _without(docs, verdict.where("not sound").select("doc_id", "text_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, with the smallest doc_id; repeated rows count as duplicates."""
    verdict = near_dedup.one_of_each(docs, threshold=0.8)
    named = cut(verdict.groupBy("doc_id", "text_key").agg(F.max("one").alias("stays"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
                .where("not stays or n > 1 and n_shingles > 0"))
    # Rows with the same id and text differ in other columns at most: the smallest by these stays.
    again = named.where("stays").select("doc_id", "text_key")
    if again.isEmpty():
        return _without(docs, named)
    key = _unused(docs, "text_key")
    few = _of_rows(docs, again, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(key))
    whole = F.struct(*map(_column, docs.columns))  # its JSON orders columns of any type
    few = few.agg(F.min_by(whole, F.to_json(whole)).alias(_unused(docs, "row"))).select(f"{_unused(docs, 'row')}.*")
    return _without(docs, named).unionByName(few)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    verdict = decontaminate.contamination(docs, items)
    return _without(docs, verdict.where("n_hit > 0").select("doc_id", "text_key"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; n_chars follows. All other columns stay as they are."""
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # apart from the operator's own names
    found = pii.find(docs.select("doc_id", "text", *[_column(c).alias(n) for c, n in others.items()]), pii.train(docs))
    now = {"doc_id": F.col("doc_id"), "text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[now.get(c, F.col(others.get(c, c))).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as the ids of its pieces."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that ``gone`` does not name by doc_id and hash of the text."""
    return _of_rows(docs, gone, "left_anti")


def _of_rows(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with the rows that ``named`` names by doc_id and hash of the text; docs may have any columns."""
    at, key = _unused(docs, "doc_id_named"), _unused(docs, "text_key_named")
    named = named.select("doc_id", "text_key").distinct().select(F.col("doc_id").alias(at), F.col("text_key").alias(key))
    return docs.join(named, F.col("doc_id").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(key)), how)


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("encoding", encoding)]

#: The groups of near duplicates, a trained model and the segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

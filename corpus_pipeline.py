"""The corpus pipeline: stages over ``documents``, each written before the next reads it.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
All but the last return the columns of their input, whatever they are. A document is known by its
doc_id and a hash of its text, so rows of one id with other texts are judged on their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.llm import decontaminate, lang_id, mixing, ngram_join, token_output
from wardstat.llm.tables import join_rows, keyed, read, written
from wardstat.session import drop_scratch, scratch_folder, scratch_mark

#: below this mean probability no language is told
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, texts without a letter, and texts
    whose likeliest language has a score under ``MIN_SCORE`` go."""
    # the text goes to Python and back once; the other columns beside it, whatever their names
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("other")
    out = lang_id.identify(docs.select(other, "text"), lang_id.learned(docs), carry=["other", "text"])
    told = out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return told.select(*["text" if c == "text" else f"other.`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest doc_id; documents
    without words are in no group and stay."""
    verdict = written(ngram_join.join(docs).where("n_shingles > 0"), "pipeline-groups")
    other = verdict.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row").distinct()
    kept = join_rows(keyed(docs), other, "left_anti")
    twice = written(verdict.groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "pipeline-twice")
    if twice.limit(1).count():  # repeated rows: one of each stays
        once = join_rows(kept, twice, "left_semi").dropDuplicates(["doc_id", "row"])
        kept = join_rows(kept, twice, "left_anti").unionByName(once)
    return kept.select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no or too few words of benchmark windows."""
    verdict = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    bad = written(verdict.where(decontaminate.contaminated()).select("doc_id", "row").distinct(), "pipeline-contaminated")
    return join_rows(keyed(docs), bad, "left_anti").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to three times."""
    taken = mixing.mix(docs).groupBy("doc_id", "row").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = written(taken, "pipeline-taken")
    rows = keyed(docs)
    if taken.where("rows > 1").limit(1).count():  # the copies of repeated rows are counted together
        rows = rows.dropDuplicates(["doc_id", "row"])
    picked = join_rows(rows, taken.where("copies > 0").select("doc_id", "row", "copies"), "inner")
    return picked.select("d.doc", F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int")))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: place, number and checksum of each document's ids."""
    path = scratch_folder(spark, "llm-shards")
    token_output.write_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_shards(spark, path)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_output", tokens),
]

#: language ID and the token ids can't be told in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. A stage's own intermediates, and what the stage
    before wrote, are deleted once its result is written."""
    docs = read(spark, sf_dir, "documents")
    mark = scratch_mark(spark)
    for name, stage in STAGES[:-1]:
        path = scratch_folder(spark, f"llm-pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_scratch(spark, mark, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from documents: toxicity, near duplicates, personal data, mixing, packing.

Each stage is one of the operators of ``tidewater.llm``, all but the near
duplicates with the parameters of its own query.  It gets all that the stage
before it kept, as a table read again from Parquet; all stages but the last
return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import copies, mixing, packing, pii, toxicity
from tidewater.llm.common import Scratch, spare
from tidewater.llm.queries import held_out


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels, score = spark.read.parquet(f"{sf_dir}/labels.parquet"), spare("toxicity", docs.columns)
    return toxicity.score(docs, labels, ~held_out(), into=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    SimHash with the general parameters of stages on shingles, not those of op2's digest: five words instead of three,
    128 bits compared at a radius that reaches a similarity of 0.8, which is then checked on the shingles themselves.
    """
    return copies.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans with personal data become the names of their kinds; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    prefix = spare("mix_", [c[:5] for c in docs.columns])
    return mixing.emit(mixing.mix(docs, prefix=prefix), prefix=prefix).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with the sequences of 4096 tokens that they go to."""
    return packing.pack(docs, capacity=4096)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the classifier or XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the tables between them lie in the shared folder."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

"""A training-data pipeline of five stages over documents; the last packs what the others keep.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes each
stage's rows as Parquet in the shared folder and reads them again, so that a lost executor costs one stage at most.

Classifiers learn from the labelled rows of sf_dir (held-out rows apart). Rows with null ids pass the near-duplicate stages as
they are; null and empty texts are neither toxic nor bad by themselves: they get the classifiers' score of an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import op1_minhash, op2_packing, op5_toxicity, op7_suffix_index, op8_line_crf
from postloom.llm.common import Scratch
from postloom.session import ship

#: Near-duplicate groups of the pipeline: five-word shingles, similarity 0.8 or more.
WORDS, PERCENT = 5, 80
TOXIC, GOOD = 0.5, 0.3


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    ship(spark)
    name = _free(docs, "toxicity_score")
    scored = op5_toxicity.score_rows(docs, op5_toxicity.fit(*_tables(spark, sf_dir)), score_col=name)
    return scored.where(F.col(name) < TOXIC).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    ship(spark)
    name = _free(docs, "quality_score")
    scored = op8_line_crf.score_rows(docs, op8_line_crf.fit(*_tables(spark, sf_dir)), score_col=name)
    return scored.where(F.col(name) >= GOOD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id. Rows of one id are one document."""
    ship(spark)
    found = op1_minhash.near_duplicates(spark, docs, width=WORDS, percent=PERCENT).where("doc_id is not null")
    status = Scratch(spark).save(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "status")
    name = _free(docs, "gone")
    gone = status.where("not kept").select(F.col("doc_id").alias(name))
    few = gone.count() <= op1_minhash.BROADCAST_ROWS  # some MB of ids; beyond it the texts are shuffled
    rows = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone[name], "left_anti")
    if status.where("n > 1").isEmpty():
        return rows
    return rows.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rows.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that a document with a smaller id holds. A character of which bytes went is
    dropped whole; n_chars counts what is left."""
    ship(spark)
    carry = {f"carried_{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    left = op7_suffix_index.without_repeats(spark, docs, carry=carry, as_text=True)
    fields = {f.name: f.dataType for f in docs.schema.fields}
    back = {c: F.col(a) for a, c in carry.items()} | {"doc_id": F.col("doc_id").cast(fields["doc_id"]), "text": F.col("kept")}
    if "n_chars" in fields:
        back["n_chars"] = F.length("kept").cast(fields["n_chars"])
    return left.select(*(back[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    import public_tokenizers

    ship(spark)
    return op2_packing.pack(spark, op2_packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]

#: SQL has no word for the trained stages; tests/llm compares the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs

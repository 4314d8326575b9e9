"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it back as the next one's ``docs``.  All stages but the last return the columns
of documents.  A stage keeps repeated rows, nulls and extra columns as its operator does.
"""

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from public_tokenizers import path as tokenizer_path  # noqa: E402

from staylens.llm import decontam, langid, packing, simhash, suffix_dedup  # noqa: E402
from staylens.llm.common import TEXTS_PER_BATCH, stored  # noqa: E402

LEAST_LANGUAGE_SCORE = 0.5
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without text or letters, and rows whose best language has a probability below one half.

    The language model is fitted on the rows' own ``lang``; where no row has one, only rows without letters go.
    """
    model = langid.fit(docs)
    judged = langid.predict(docs.select("text", F.struct(*_columns(docs)).alias("row")), model)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    keep = sure if model.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return stored(judged.filter(keep).select("row.*"), "language-kept", TEXTS_PER_BATCH)  # rows with texts reach the workers in small batches


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of texts linked by a five-word similarity of 0.8 or more."""
    return simhash.keep_one_of_similar(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every byte of a 200-byte string that starts more than once out of the texts.

    A character of which only some bytes are left goes as well.  Documents stay, with ``n_chars`` counted anew; the text of
    a document without repeats, also a null one, is not touched.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*_columns(docs.select(*others)), F.col("text").isNull().alias("_null")).alias("row")
    done = suffix_dedup.dedup(docs.select("doc_id", "text", row))

    @F.pandas_udf("string")
    def decoded(parts):
        return parts.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")

    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(decoded(F.when(F.col("n_removed") > 0, F.col("kept"))))
    done = done.select("row", F.when(~F.col("row._null"), text).alias("text"))
    fresh = {"text": F.col("text")}
    if "n_chars" in others:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window (10 words, or a whole shorter item).

    Rows go by the 64-bit hash of their text, which alone decides; ids may be null or repeated.
    """
    own = F.xxhash64("text")
    found = decontam.decontaminate(docs.select(own.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.filter("contaminated").select(F.col("doc_id").alias("_text_hash")).distinct()
    return docs.join(dirty, own == dirty["_text_hash"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path(TOKENIZER))


def _columns(docs: DataFrame) -> list:
    """All columns, packed by the stages so that no column of an operator can meet one of theirs."""
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("language_id", language_id), ("simhash_near_duplicates", near_duplicates), ("suffix_array_repeats", repeated_passages),
          ("benchmark_decontamination", benchmark_passages), ("harmonic_packing", pack)]

#: language scores come from a fitted model and sequences from a packer, which SQL cannot state; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])

"""The corpus pipeline: filters, deduplication and packing, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it below
the shared checkpoint folder and reads it again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``.

* toxicity: documents scored at or above the threshold go;
* language_id: documents without a known language, or of an unsure one, go;
* exact_dedup: of equal texts one document stays;
* ngram_jaccard: of near copies (0.8 of the shingles of five words) one document of each
  group stays;
* packing: the pieces of what is left, with their places in sequences.

Defined cases: a null or empty text is scored by its marks in toxicity, has no letter and so goes
at language_id, as do texts without a letter; null lang, source and n_chars are kept as they are; a
null doc_id ranks last, so its row stays only where it is alone in its group; very long texts
are read whole; of rows that repeat a doc_id and its text one stays (exact_dedup), of ties the
smallest doc_id; further columns come along whatever their names (the stages' own names
cannot clash); an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tmaps.llm import exact_dedup, language, ngram_join, packing, toxicity
from tmaps.llm.common import stored, table


NEAR_WORDS, NEAR_PERCENT = 5, 80


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", _toxicity),
    ("language_id", _language),
    ("exact_dedup", _exact),
    ("ngram_jaccard", _near),
    ("packing", _packing),
]

#: Learned stages have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""From raw documents to tokens: quality rules, line dedup, near-duplicate join, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read back as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm import bpe, common, jaccard, line_dedup, mixing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language's reference both keep.

    Null and empty texts go, as they have no words. Repeated rows stay or go together; ids aren't looked at.
    """
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; a document of which no line with words is left goes.

    The copy with the smallest id stays, null ids first. A null text, and one without words, has no lines and stays as it is;
    rows equal in id and text are one document and get equal texts.
    """
    left = line_dedup.line_dedup(docs.select(*COLUMNS)).where("n_deleted < n_lines OR n_lines = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 join, the document with the smallest id.

    Rows without id come last, and of rows that share an id that with the least hash stays; of rows equal in id and text
    one does. Rows without words link with nothing and stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; repeats are rows of their own.

    Null is a source like any other; a row without words has no size, and the mix doesn't take it.
    """
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the bytes they decode to; a null text counts as empty."""
    import public_tokenizers

    tokens = bpe.bpe(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each through a table in the shared folder. An empty table gives an empty one."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs, name.replace(" ", "-"))
    return docs


#: Token ids are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}

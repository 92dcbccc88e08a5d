"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: of each group of near copies (5-word shingles, similarity 0.8 or more) the smallest id stays.
3. secrets: secrets in the texts are replaced by their kind; no document goes.
4. mixture: documents are repeated or left out so that the sources meet their target weights.
5. tokens: texts become byte-level BPE ids; counts and hashes of ids and of the decoded text are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import bpe, jaccard, mixing, quality, secrets
from tidepool.llm.common import Staging, documents

STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", jaccard.keep_one),
    ("secrets", secrets.redact_documents),
    ("mixture", mixing.mix_documents),
    ("tokens", bpe.tokenize),
]
#: Compression, backtracking and the regular expressions have no SQL counterpart; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging, docs, before = Staging(spark), documents(spark, sf_dir), None
    for name, stage in STAGES:
        out = staging.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            staging.drop(before)
        docs = before = out
    return docs

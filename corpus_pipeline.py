"""The corpus pipeline: documents pass through the stages in order; each is written and read again before the next."""

from __future__ import annotations

import uuid

from weftgraph.llm import decontam, jaccard, linerules, pieces, pii
from weftgraph.llm.common import delete, read_table, shared_dir


def quality_rules(spark, docs, sf_dir):
    """Documents that pass, without their failing lines."""
    return linerules.clean(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near copies."""
    return jaccard.clean(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item, as it is or with other parameters."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonyms(spark, docs, sf_dir):
    """Personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymise(docs)


def sentencepiece(spark, docs, sf_dir):
    """The piece ids of every document, and whether they decode to its text."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pseudonyms),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL can express neither the line rules nor the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another; what one wrote is deleted once the next has been written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if before:
            delete(spark, before)
        before = f"{folder}/{k}"
    return docs

"""The corpus pipeline: documents through five operators of the training-data subpackage, each stage written and read again.

Language identification drops texts without a recognised language; the similarity join keeps one document of each group of
near copies; decontamination drops documents with benchmark passages; the secret scan blanks secrets out; packing places what is left
into sequences.

Rows, for all stages: null and empty texts leave at language identification, and what is said of them elsewhere holds where a stage
runs alone; null ids are kept like others; very long texts are read whole; columns beside doc_id and text are handed on as they are,
whatever their names (but n_chars, which the secret scan sets anew); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, language, packing, secrets, similarity
from lodestone.llm.common import Workspace, cut, removed, table

LANGUAGES = None  # all that have labelled texts
LEAST = 3 / language.DIM**0.5  # three times the spread of a random text's cosine


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one of LANGUAGES with a score of LEAST or more.  Rejected are null, empty and letterless texts, and those that are no
    nearer to any language than chance.  Without a single labelled text, only the first three go.  Repeated rows fare alike; of equal
    scores the language first in order counts."""
    return language.recognised(docs, language.profiles(docs), LANGUAGES, LEAST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, a null id after all others, then the least md5 of the
    text; of rows repeated with id and text any one.  Wordless, null and empty texts are in no group and stay."""
    return similarity.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null, empty and wordless texts have none.  Without benchmark items all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in place of each secret; overlapping ones as the first; null texts stay null."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their sequences; a null or empty text is one piece of one id; repeated rows are packed each."""
    return packing.pack(cut(packing.pieces(docs), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language profiles and sampled paths can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's tables go when its successor's input is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Workspace(spark) as tables:
            docs = tables.keep(cut(stage(spark, docs, sf_dir), name))
        if last:
            removed(spark, last)
        last = docs.written_at
    return STAGES[-1][1](spark, docs, sf_dir)

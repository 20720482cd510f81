"""The document pipeline: language ID, line dedup, near-duplicate removal, repeat removal, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and, but for the
last, returns the columns it was given.  A language is rejected only where no letter is
present or no language scores ``MIN_SCORE``; documents that a stage empties go.

Edge cases, in every stage: a null id is an id like any other; very long texts are taken
whole; repeated rows are rows of their own; extra columns of any name pass through (the
last stage reads id and text alone); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import langid, line_dedup, ngram_join, packing, shared, suffix_dedup
from depweave.llm.queries import tokenizer_file
from depweave.session import table, written

#: Scores of clean documents are far above; junk of no language falls below.
MIN_SCORE = 0.15
#: Near-duplicates: five-word shingles, Jaccard similarity in percent.
WORDS, PERCENT = 5, 80


def _with_text(changed: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs``, in their order, with a new text (and its length, if they hold one)."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return changed.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("text", "n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language that the labelled ones teach (operator 1); null and empty texts have none and go, repeated rows go or stay together."""
    marked = docs.select("doc_id", "text", "lang", F.coalesce(langid.is_held_out(), F.lit(False)).alias("held"))
    model = langid.train(marked.filter("not held"))
    (found,) = shared.free(docs.columns, "found")
    scored = docs.withColumn(found, langid.predicted(model, F.col("text")))
    return scored.filter((F.col(found)["lang"] != langid.UNKNOWN) & (F.col(found)["score"] >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one (operator 4); null and empty texts have no lines and stay as they are."""
    text, n_lines, gone = shared.free(docs.columns, "left", "n_lines", "n_gone")
    found = line_dedup.remove_similar_lines(docs, _others(docs), (text, n_lines, gone))
    emptied = (F.col(gone) > 0) & ~F.col(text).rlike(r"\S")
    return _with_text(found.filter(~emptied | F.col(text).isNull()), docs, text)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked ones (operator 5); texts without a word are linked with nothing and stay, rows with a null id stay, rows of one id go or stay together."""
    found = ngram_join.link_components(docs, words=WORDS, percent=PERCENT)
    return docs.join(found.filter("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that one of a smaller id holds (operator 8); null and empty texts and those of fewer than 50 bytes stay as they are, rows of one id take nothing from one another."""
    names = shared.free(docs.columns, "n_bytes", "n_cut", "n_spans", "left")
    found = suffix_dedup.remove_repeats(docs, _others(docs), names)
    emptied = (F.col(names[1]) > 0) & ~F.col(names[3]).rlike(r"\S")
    return _with_text(found.filter(~emptied | F.col(names[3]).isNull()), docs, names[3])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their sequences and places (operator 7); a null or empty text is one piece, its end token."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_similar_lines),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack),
]

#: Classification, suffix transforms and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs

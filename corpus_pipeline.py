"""A corpus pipeline of training-data operators, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, language_id, line_dedup, mixing, near_copies
from tallyloom.llm.common import fold, settle, table

#: The columns of documents, which every stage but the last gives.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is of no learned language if random characters make it so many times likelier, in log10, than each of them does.
EVIDENCE = 3.0
#: And so many times likelier, in log10, for each character: a short text that is half a key is above that, random letters are at -0.9 to -1.3.
RATE = 0.6


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; a document without a lang gets the one that is predicted.

    Languages are learned from the labelled documents, a fifth of them (by id) left out.  A document goes if its text is null or without a letter, or if
    random characters make it a thousand times likelier, and each of its characters four times, than every language does: codes, keys, scripts that no label names.  A text too
    short to tell, prose with a key in it, or a text between two languages stays, whichever is predicted.  Where no row has a lang to learn from, only the test for a letter holds.

    Repeated rows are judged alike and stay, as do null ids; an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    langs, weights = language_id.train(docs, fold() != 0)
    if not langs:
        return language_id.with_letters(docs)
    found = language_id.predict(docs, langs, weights, margin=True)
    known = (F.col("margin") > -EVIDENCE) | (F.col("margin") > F.col("characters") * -RATE)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; n_chars is counted anew.

    No row goes.  A line of 40 characters or more in five documents or more stays in the one of the largest doc_id; repeated rows of one id are one document and are cut
    alike, rows without an id lose such lines; a null text becomes an empty one.
    """
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    The least doc_id of a group stays, with all its repeated rows; rows without an id stay.  Texts without a word, null ones among
    them, are copies of each other.
    """
    return near_copies.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs: ten words in a row, or a whole shorter item.

    Rows are judged one by one; a null text has no passage.  Null and wordless items match nothing, and an empty benchmark leaves all rows.
    """
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that the sources reach their weights.

    A row for every row of *docs*; a null source is a source, a null text has no words, ties go by a hash of the id.  :func:`mixed_texts` gives the texts.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_texts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The corpus itself: the rows that the last stage was given, as often as it says."""
    return mixing.repeated(docs.select(*COLUMNS), counts)


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Language ID and fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

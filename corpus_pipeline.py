"""Corpus pipeline: language ID, quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as Parquet
to the shared folder and reads again as the next stage's docs. All stages but the last return the
columns of ``documents``. Verdicts go back to rows by a row key, since doc_ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.llm import langid, mixing, neardup, packing, quality_rules
from fotolith.llm.common import table, written
from fotolith.llm.queries import language_model, tokenizer_path, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "_row"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row that stays the same when a plan runs again: the number of its file,
    by name, and its place in it. What isn't a table read from files is written first."""
    try:
        # Only a plan that is nothing but the read has each place once.
        at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")) if docs._jdf.queryExecution().analyzed().children().isEmpty() else None
    except AnalysisException:
        at = None
    if at is None:
        return keyed(written(docs, "rows"))
    files = at.select("_file").distinct().select(F.col("_file").alias("_name"), F.row_number().over(Window.orderBy("_file")).cast("long").alias("_number"))
    # One row for each file: less than the driver's own list of the table's files.
    return at.join(F.broadcast(written(files, "files")), F.col("_file") == F.col("_name")).select(*docs.columns, (F.shiftleft("_number", 40) + F.col("_at")).alias(ROW))


def keep(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the keyed ``rows`` that ``wanted`` holds."""
    return rows.join(wanted.select(ROW), ROW, "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field tells, code-switched ones too; those that are ``und``, without a
    letter, go. If the learning folds have no lang, no language can be told and all with a letter stay.

    Null texts and texts without a letter go; a row's verdict depends on its text alone and goes back
    to it by a row key, so null and repeated doc_ids and equal rows are each judged by themselves; an
    empty table gives an empty one; other columns are left behind. (Carrying the texts through the
    Python workers spares the join, but took executors over their memory.)
    """
    model = language_model(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    rows = keyed(docs)
    told = langid.predict(rows.select(F.col(ROW).alias("doc_id"), "text"), model).withColumnRenamed("doc_id", ROW)
    return keep(rows, told.where("lang_pred <> 'und'"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest.

    Null texts fail; null doc_ids can't be labelled but are judged; rows of one doc_id are each judged by
    their own text, under a row key, and equal rows alike; an empty table gives an empty one; other
    columns are left behind.
    """
    rows = keyed(docs)
    return keep(rows, quality_rules.quality_rules(rows, table(spark, sf_dir, "labels"), carry=(ROW,)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of smallest doc_id (null last); of rows that tie the
    first.

    Rows are compared by their own texts under a row key, also those without a doc_id and several of
    one doc_id; of equal rows one stays. Null texts and texts without words are nobody's copy and
    stay. An empty table gives an empty one; other columns are left behind.
    """
    rows = keyed(docs)
    # Written: with what follows it would be one plan of all joins, which the driver holds and plans again after each.
    group = written(neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW))
    kept = group.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first.alias("first")).select(f"first.{ROW}")
    return keep(rows, kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in their sources' target shares: those the mix reads twice come twice, those it
    doesn't reach go, and where a target ends inside a document its text ends after that word. Each copy
    stands at the slot of the mix in which it begins: that is the order of the rows, and of the part
    files by name when they are written.

    Null texts have no words and go; a null source is a source of its own; rows of one doc_id, and
    equal rows, are told apart by a row key, so no text comes more than twice for each of its rows; a
    very long text stands where its first block does; an empty table gives an empty one; other
    columns are left behind.
    """
    keys = keyed(docs)
    taken = mixing.mix_documents(keys.select("doc_id", "source", word_count().alias("size"), ROW), "size", carry=(ROW,))
    reading = lambda e, name: F.struct(F.col(f"{name}_words").alias("words"), F.col(f"{name}_slot").alias("slot"), F.lit(e).alias("epoch"))
    times = F.filter(F.array(reading(0, "first"), reading(1, "second")), lambda r: r["words"] > 0)
    copies = taken.select(ROW, "size", "position", F.inline(times))
    rows = keys.join(copies, ROW).orderBy("slot", "epoch", "position")
    # The front of a text up to its n-th word, as it stands there: parts end where words end.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    front = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), front).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens, one row each, with the piece's place in its document and
    sequence. Null and empty texts are the end id alone; null and repeated doc_ids stay as they are; a
    very long text fills sequences of its own; an empty table gives an empty result."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language), ("quality rules", rules), ("near-duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

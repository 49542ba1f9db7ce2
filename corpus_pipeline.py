"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept:

1. ``language_id`` drops documents that language identification rejects (no letters, or far from every centroid);
2. ``near_duplicates`` keeps one document, that with the smallest id, of each component of the shingle join;
3. ``decontaminate`` drops documents in which a window of a benchmark item occurs;
4. ``pii`` replaces personal data in the texts by ``<kind>`` and brings ``n_chars`` up to date;
5. ``sentencepiece`` turns the texts into subword ids.

All but the last return the columns of ``documents``.  Defined cases: null texts are rejected by the first stage; rows with a
null id are never near duplicates; of rows that repeat an id and its text one stays, rows that share an id but differ in
text are judged each by its own text; an empty table goes through all stages; further columns of the input stay (up to the last stage).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabshift.llm import decontam, langid, ngram_join, pii, subword
from vocabshift.llm.common import discard, give_back, map_rows, read_table, stored, text_slices


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that language identification does not reject."""
    model = langid.fit_documents(docs)
    give_back()  # the sample's memory, which the driver would hold through the other stages
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, at, langid.BATCH_BYTES, langid.BATCH_ROWS):
                keep = [not rejected for *_, rejected in shared.value.predict(texts)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run, _columns(docs))


def _one_text_an_id(docs: DataFrame) -> DataFrame | None:
    """(doc, id) of the rows with an id, where texts that share an id have got ids of their own; None if no id has several texts.

    Of an id's texts that with the least checksum keeps the id, the others get ids beyond the largest.
    """
    named = docs.where("doc_id is not null")
    own = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    prints = named.select("doc_id", own.alias("print")).distinct()
    several = prints.groupBy("doc_id").agg(F.min("print").alias("print"), F.count("*").alias("texts")).where("texts > 1")
    several = stored(several, "several")
    if not several.limit(1).count():
        discard(several)
        return None
    places = prints.join(several.select("doc_id"), "doc_id", "left_semi")
    places = places.join(several.select("doc_id", "print"), ["doc_id", "print"], "left_anti")
    places = stored(places.withColumn("place", F.monotonically_increasing_id()), "places")  # written once, so they stay
    largest = named.agg(F.max("doc_id")).first()[0]
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", own.alias("print"))
    new = F.col("place") + F.lit(largest + 1)
    return rows.join(places, ["doc_id", "print"], "left").select("doc", F.coalesce(new, F.col("doc_id")).alias("id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, judged by its own text; rows with a null id stay."""
    rows = _one_text_an_id(docs)
    if rows is not None:
        rows = stored(rows, "rows")
        out = _one_of_each(rows.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text"), "doc")).select("doc.*")
    else:
        out = _one_of_each(docs)
    return out.unionByName(docs.where("doc_id is null"))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of the rows with an id; an id has one text."""
    found = stored(ngram_join.near_duplicates(docs.select("doc_id", "text")), "components")
    kept = found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = stored(kept.select(F.col("doc_id").alias("kept_id"), F.col("rows").alias("kept_rows")), "kept")
    discard(found)
    columns = [F.col(c) for c in docs.columns]
    by_id = F.col("doc_id") == F.col("kept_id")
    out = docs.join(kept.where("kept_rows = 1"), by_id, "left_semi").select(*columns)
    if kept.where("kept_rows > 1").limit(1).count():
        again = docs.join(kept.where("kept_rows > 1"), by_id, "left_semi").select(*columns)
        out = out.unionByName(again.dropDuplicates(["doc_id"]))
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item."""
    names = tuple(docs.columns)
    found = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=names)
    return found.where("n_hit = 0").select(*names)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked."""
    out = pii.masked(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
        out = out.withColumn("n_chars", size)
    return out.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of the documents."""
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    encoded = subword.encode(docs, keep=keep)
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", mask_pii),
    ("sentencepiece", sentencepiece),
]

#: Stages 1 and 5 cannot be said in SQL; tests/llm compares the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs

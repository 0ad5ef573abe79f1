"""A training corpus from raw documents: judged, deduplicated, decontaminated, mixed and sharded.

Each stage works on all rows that its predecessor kept and returns the columns of
``documents``; the last one adds where every row went. A stage decides on narrow
columns and meets the rows with its decisions once, so whole texts are shuffled once
at most. Rows are told apart by where they are stored, and their columns are renamed
meanwhile, so any other column comes through unchanged, whatever its name.

``run`` writes each result to the shared folder and reads it again, so no stage
depends on the executors of an earlier one, and deletes what a stage no longer needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import curriculum, decontamination, quality, sharding, shingle_join
from tillsight.llm.rows import ROW, Veiled
from tillsight.llm.shipping import ship_package
from tillsight.plans.materialize import drop, materialize, only_kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE, PERCENT = 5, 80
SHARDS = 8


def _document(rows: Veiled) -> Column:
    """Id and text of a row, without nulls inside, so that a join by it meets rows without an id."""
    return F.struct(
        rows.col("doc_id").isNull().alias("unnamed"),
        F.coalesce(rows.col("doc_id"), F.lit(0).cast(rows.df.schema[rows["doc_id"]].dataType)).alias("id"),
        F.xxhash64(rows["text"]).alias("text"),
    )


def _never_broadcast(decisions: DataFrame) -> DataFrame:
    """Decisions grow with the corpus: rows meet them by one shuffle at every size."""
    return decisions.hint("merge")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject.

    The classifier and the sites are learnt from these documents. Null and empty
    texts are scored as texts without words.
    """
    ship_package(spark)
    rows = Veiled(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    site = {"key": rows["doc_id"], "host": rows["source"], "path": rows["lang"]}
    slim = materialize(quality.document_features(rows.df, list(site.values()), rows["text"]))
    truth = labels.select(F.col("doc_id").alias(site["key"]), "quality")
    model = quality.learn(slim, truth, **site)
    drop(slim)
    scored = model.score(quality.document_features(rows.df.drop(ROW), rows.df.drop(ROW).columns, rows["text"]))
    return rows.restore(scored.where(F.col("quality_score") >= quality.THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, null last, then by a hash of the text.

    Texts without words are linked with nothing and stay. Rows that repeat id and
    text are one document, also where the id is null, and the first one stored stays.
    Documents are told apart by id and text, so different texts under one id are
    judged each.
    """
    ship_package(spark)
    rows = Veiled(docs)
    keyed = rows.df.withColumn("document", _document(rows))
    classes = shingle_join.shingle_classes(keyed, "document", rows["text"], size=SHINGLE, percent=PERCENT)
    copies = classes.where("component_id != document").select("document").distinct()
    met = keyed.groupBy("document").agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # no row of a copy stays, and one of a document that is stored several times
    goes = materialize(
        copies.withColumn("copy", F.lit(True))
        .join(met.select("document", "first"), "document", "full")
        .select(F.col("document").alias("of"), F.when(F.col("copy").isNull(), F.col("first")).alias("stays"))
    )
    drop(classes)
    left = keyed.join(_never_broadcast(goes), F.col("document") == F.col("of"), "left")
    return rows.restore(left.where(F.col("of").isNull() | F.coalesce(F.col(ROW) == F.col("stays"), F.lit(False))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship_package(spark)
    rows = Veiled(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_passages(rows.df.drop(ROW), benchmark, text=rows["text"])
    return rows.restore(found.where(F.size("hits") == 0))


def _sized(rows: Veiled, *more: Column) -> DataFrame:
    """What a mix needs to know of each row, and ``more``."""
    return rows.df.select(
        ROW,
        _document(rows).alias("document"),
        rows.col("doc_id").alias("doc_id"),
        rows.col("source").alias("source"),
        curriculum.word_count(rows.col("text")).alias("size"),
        curriculum.stream_order(rows.col("doc_id"), rows.col("text")).alias("order"),
        *more,
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that training reads, each as often as the mix reads it, whole each time.

    Documents without words are never read, those of a source beyond its target
    neither. When each is read follows from the result (``curriculum.replay``).
    """
    rows = Veiled(docs)
    sized = materialize(_sized(rows))
    sources = curriculum.targets(curriculum.weigh_by_rank(curriculum.source_sizes(sized)))
    mixed = curriculum.mix(sized, sources).select(F.col(ROW).alias("of"), F.size("copies").alias("uses"))
    uses = materialize(mixed.where("uses > 0"))
    drop(sized)
    read = rows.df.join(_never_broadcast(uses), F.col(ROW) == F.col("of")).withColumn("use", F.explode(F.sequence(F.lit(1), "uses")))
    return rows.restore(read)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``epoch`` and ``position`` in the curriculum, and with place, shard and slot.

    Places follow the positions and are shuffled within windows, so that every shard
    is read in the order of the curriculum. Rows without words come last.
    """
    rows = Veiled(docs)
    crc = F.crc32(F.encode(F.coalesce(rows.col("text").cast("string"), F.lit("")), "UTF-8"))
    sized = materialize(_sized(rows, crc.alias("text_crc32")))
    read = materialize(curriculum.replay(sized, "document", ROW).drop("size"))
    drop(sized)
    order = [F.col(c) for c in ("source", "order", "document", "epoch", ROW)]
    more = ["text_crc32", "epoch", "position", "place", "shard", "slot"]
    placed = sharding.shard_in_order(read, "position", order, SHARDS).select(F.col(ROW).alias("of"), *more)
    return rows.restore(rows.df.join(_never_broadcast(materialize(placed)), F.col(ROW) == F.col("of")), *more)


STAGES: list[tuple[str, Stage]] = [
    ("quality", judge_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier and the sketches have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = docs
        with only_kept() as keep:
            docs = keep(materialize(stage(spark, before, sf_dir)))
        drop(before)
    return docs

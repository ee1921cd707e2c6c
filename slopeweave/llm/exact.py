"""Exact duplicates by a distributed sort of the contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slopeweave.session import cut

PREFIX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A sort key with more than this share of a partition's rows is spread over several partitions.
HOT_SHARE = 0.25
PARTITION_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else; null as empty. Texts of ASCII only take the faster way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _keyed(docs: DataFrame) -> DataFrame:
    """The whole row, and a cheap sort key that equal texts share: the first characters and a hash
    of some more and of the length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.lower(F.substring(text, 1, 4 * PREFIX))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                       F.substring(head, 1, PREFIX).alias("head"), F.xxhash64(head, F.octet_length(text)).alias("rest"))


def _sorted(keyed: DataFrame, parts: int, keys: list[str], whole: bool) -> DataFrame:
    """Range-partition on the keys and add the normalised text; the row keeps its own text only if ``whole``."""
    ranged = keyed.repartitionByRange(parts, *keys).withColumn("norm", normalised(F.col("row.text")))
    return ranged if whole else ranged.withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id")))


def runs(docs: DataFrame, keep: str = "max", whole: bool = True) -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` (its id only, unless ``whole``), with ``norm``, ``keep_id``, ``group_size`` and ``first``.

    The rows are range-partitioned on sort keys with sampled splitters and sorted within
    their partition (external sort), so that equal normalised texts stand side by side; runs of neighbours whose whole
    normalised texts are equal form the groups. ``keep_id`` is the largest id of the group (``keep="min"``:
    the least); a null id only where the group has no other. ``first`` marks one row of the group, one with
    ``keep_id``, also among repeated rows.

    A key that holds many rows is split: its rows get a salt by id, each piece is sorted and
    grouped by itself, and the groups of the pieces, one row each, are then joined by their texts.
    """
    spark = docs.sparkSession
    best = F.max if keep == "max" else F.min
    order = F.desc_nulls_last("id") if keep == "max" else F.asc_nulls_last("id")
    keyed = _keyed(docs)
    counts = cut(keyed.groupBy("rest").agg(F.count("*").alias("n"), F.sum(F.octet_length("row.text")).alias("bytes")), "counts")
    rows, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES), 1)
    most = max(HOT_SHARE * rows / parts, 1.0)
    # No more than parts / HOT_SHARE keys can hold more than `most` rows each, so this table is small.
    hot = counts.filter(F.col("n") > most).select("rest", F.ceil(F.col("n") / most).cast("int").alias("pieces"))

    keyed = keyed.join(F.broadcast(hot), "rest", "left")
    cold, warm = keyed.filter("pieces IS NULL").drop("pieces"), keyed.filter("pieces IS NOT NULL")
    group = Window.partitionBy("head", "rest", "norm")
    grouped = (_sorted(cold, parts, ["head", "rest"], whole)
               .withColumns({"keep_id": best("id").over(group), "group_size": F.count("*").over(group),
                             "first": F.row_number().over(group.orderBy(order)) == 1})
               .select("row", "norm", "keep_id", "group_size", "first"))
    if hot.isEmpty():
        return grouped

    piece = Window.partitionBy("head", "rest", "salt", "norm")
    salted = warm.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    sorted_pieces = (_sorted(salted, parts, ["head", "rest", "salt"], whole)
                     .withColumns({"best": best("id").over(piece), "n": F.count("*").over(piece),
                                   "lead": F.row_number().over(piece.orderBy(order)) == 1,
                                   "digest": F.sha2("norm", 256)}))
    pieces = cut(sorted_pieces, "pieces")
    both = Window.partitionBy("rest", "norm")
    joined = (pieces.filter("lead").select("rest", "salt", "digest", "norm", "best", "n")
              .withColumns({"keep_id": best("best").over(both), "group_size": F.sum("n").over(both),
                            "top": F.row_number().over(both.orderBy(
                                F.desc_nulls_last("best") if keep == "max" else F.asc_nulls_last("best"), "salt")) == 1})
              .select("rest", "salt", "digest", "keep_id", "group_size", "top"))
    # Many copies of a text make a small file, so Spark would take the written pieces for few and send their texts to every executor.
    rest = (pieces.hint("merge").join(joined, ["rest", "salt", "digest"])
            .select("row", "norm", "keep_id", "group_size", (F.col("lead") & F.col("top")).alias("first")))
    return grouped.unionByName(rest)


def groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``: the row that stays of
    its group of equal texts, the group's size, whether this row stays, and the digest of the normalised text.
    Of repeated rows with one id one stays. An empty table gives no rows."""
    return runs(docs.select("doc_id", "text"), keep, whole=False).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", F.col("first").alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"))


def distinct_texts(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of equal texts."""
    return runs(docs, keep).filter("first").select("row.*")

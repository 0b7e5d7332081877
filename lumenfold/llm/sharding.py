"""Sharding by vector bin packing.

Groups of equal texts are vectors of bytes, words and rows. Each goes to the shard where its dot product with the
residual capacity is highest, large ones first. The packing runs in lanes: a lane is a hash range of groups with its
own equal part of every shard, so lanes pack side by side and their loads add up evenly. A group that a lane's part of
a shard can't hold whole is cut into as few pieces as it takes, row by row, as one group may hold a third of all rows,
and its rows may share an id or have none; all others stay whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage, join_hot, running_start, whole_text, word_count
from lumenfold.llm.words import join_side

#: Shards; groups that a lane packs, about; bytes that a document has besides its text.
SHARDS, LANE_GROUPS, OVERHEAD = 40, 40_000, 16


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of `sizes`, packed in the order given."""
    total = sizes.sum(axis=0)
    scaled = sizes / np.where(total > 0, total / shards, 1.0)
    residual = np.ones((shards, sizes.shape[1]))
    out = np.empty(len(sizes), dtype=np.int32)
    for i, v in enumerate(scaled):
        s = int(np.argmax(residual @ v))
        residual[s] -= v
        out[i] = s
    return out


def _pack_lane(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "words", "rows", "_name"], ascending=[False, False, False, True], kind="stable")
        pdf["shard"] = pack(pdf[["bytes", "words", "rows"]].to_numpy(dtype=float), shards)
        return pdf[["_name", "rows", "shard"]]

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS, lane_groups: int = LANE_GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, size (UTF-8 bytes plus 16), words, text_crc32, shard, slot.

    Equal texts are one group and stay in one shard unless that can't hold them (a lane's part of it, by bytes, words or rows). slot counts from 0 within
    a shard, without gaps. A null text is empty (size 16); rows without an id, or that repeat one, are documents of their
    own and placed like others; an empty table gives an empty result; further columns
    are left out.
    """
    text = whole_text(text_col)
    narrow = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), word_count(F.col(text_col)).alias("words"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_group")
    )
    # a number of its own for each row, which holds from here on as it is written
    narrow = cut_lineage(narrow.withColumn("_row", F.monotonically_increasing_id()))
    groups = cut_lineage(narrow.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), F.max("size").alias("_size"), F.max("words").alias("_words")))
    n_groups, n_rows, n_bytes, n_words = groups.agg(F.count(F.lit(1)), F.sum("_rows"), F.sum(F.col("_rows") * F.col("_size")), F.sum(F.col("_rows") * F.col("_words"))).first()
    lanes = max(1, -(-n_groups // lane_groups))
    part = lambda amount, total: F.ceil(amount * (shards * lanes) / F.lit(max(1, total or 0)))
    rows = F.col("_rows")
    pieces = F.least(rows, F.greatest(F.lit(1), part(rows, n_rows), part(rows * F.col("_size"), n_bytes), part(rows * F.col("_words"), n_words)))
    # of groups in several pieces there are at most as many as parts of shards, for each of three sizes
    several = groups.select("_group", pieces.alias("_pieces")).filter("_pieces > 1")
    piece = F.pmod(F.xxhash64("_row", F.lit("piece")), F.coalesce("_pieces", F.lit(1)))
    cut = join_side(narrow, several, "_group", "left", F.lit(96)).withColumn("_name", F.concat_ws(":", "_group", piece)).drop("_pieces")
    vectors = cut.groupBy("_name").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    placed = vectors.withColumn("_lane", F.pmod(F.xxhash64("_name"), F.lit(lanes))).groupBy("_lane").applyInPandas(_pack_lane(shards), "_name string, rows long, shard int")
    sharded = join_hot(cut, cut_lineage(placed), "_name", "rows", F.concat(F.lit("~"), F.xxhash64("_row").cast("string"))).select("_id", "_row", "size", "words", "text_crc32", "shard")
    sharded = cut_lineage(sharded.withColumn("_range", F.pmod(F.xxhash64("_row"), F.lit(512))))
    slots = running_start(sharded, ["shard"], "_range", ["_row"], F.lit(1), "slot")
    return slots.select(F.col("_id").alias(id_col), "size", "words", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}

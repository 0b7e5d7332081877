"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Every text is cut where its own content says so, each chunk is named by a 64-bit hash, and the names are verified:
one shuffle of the distinct chunks shows whether two different chunks share a name. Those that do get distinct ones.
A document is then its ordered list of names, about a hundredth of its text, and only these lists move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import SPACE_CLASS, cut_lineage, join_hot, packed, whole_text
from lumenfold.llm.words import join_side, row_name

#: A chunk has MIN_CHARS characters, then goes on to the next mark, or for MAX_MORE characters where none comes.
MIN_CHARS, MAX_MORE, MARKS = 256, 1792, ".!?;:|…。！？।"
#: Rows alike that are told apart at once.
BLOCK = 1 << 16
CHUNK = rf"(?s).{{1,{MIN_CHARS}}}+[^{MARKS}]{{0,{MAX_MORE}}}+[{MARKS}]?"


def normalised(text: str = "text") -> Column:
    """The text without its white space of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(whole_text(text), SPACE_CLASS + "+", "")


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the one with the most code points stays, then the smallest id; `kept` is true for one row of a group,
    whichever it is of rows alike in all of this. Nulls: a null text is empty, empty texts are one group, a null id comes
    after all others. Any further columns of `docs` are left out; an empty table gives an empty result. `name_of` names
    a chunk; names need not be unique, as they are verified.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.lit(None).cast("string").alias("_row_name"), F.col(text_col).alias("_doc"))
    found = cut_lineage(_decided(rows, name_of, F.col("_chars")).select("_id", F.col("_stay.i").alias("keep_id"), "group_size", (F.col("_id").eqNullSafe(F.col("_stay.i")) & (F.col("_chars") == -F.col("_stay.c"))).alias("_first"), "_sha"))
    # the rows of a group that could stay are alike, so their number is enough to mark one of them
    alike = found.filter("_first AND group_size > 1").groupBy("_id", "keep_id", "group_size", "_sha").agg(F.count(F.lit(1)).alias("_n"))
    blocks = alike.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK)))).withColumn("_from", F.col("_block") * BLOCK + 1)
    each = blocks.select("_id", "keep_id", "group_size", "_sha", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + BLOCK - 1))).alias("_k"))
    columns = [F.col("_id").alias(id_col), "keep_id", "group_size"]
    out = found.filter("NOT _first OR group_size = 1").select(*columns, F.col("_first").alias("kept"), F.col("_sha").alias("text_sha256"))
    return out.unionByName(each.select(*columns, (F.col("_k") == 1).alias("kept"), F.col("_sha").alias("text_sha256")))


def _decided(rows: DataFrame, name_of: Callable[[Column], Column] = F.xxhash64, *more: Column) -> DataFrame:
    """Each of `rows` (_id, _row_name, _doc) with _sha, its group_size and the row that stays of its group, as _stay (c, z, i, r); `more` may name _chars."""
    base = rows.select("_id", "_row_name", whole_text("_doc").alias("_text"), normalised("_doc").alias("_norm"))
    cut = base.select("_id", "_row_name", F.length("_text").alias("_chars"), "_norm", chunks_of(F.col("_norm")).alias("_chunks"))
    distinct = cut.select(F.explode("_chunks").alias("_chunk")).select(name_of(F.col("_chunk")).alias("_name"), "_chunk").distinct()
    shared = distinct.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_name")
    shared = cut_lineage(shared)
    recipes = cut.select("_id", "_row_name", "_chars", F.transform("_chunks", lambda c: name_of(c)).alias("_recipe"), F.sha2("_norm", 256).alias("_sha"))
    if not shared.isEmpty():
        recipes = _told_apart(cut, distinct, shared, name_of)
    stay = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row_name").alias("r")))
    groups = recipes.groupBy("_recipe").agg(stay.alias("_stay"), F.count(F.lit(1)).alias("_rows"))
    # only groups of two or more are joined; a row of its own is its own group
    groups = cut_lineage(groups.filter("_rows > 1").withColumn("group_size", F.col("_rows")))
    alone = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row_name").alias("r"))
    found = join_hot(recipes, groups, "_recipe", "_rows", F.array(F.xxhash64("_id", "_row_name")))
    return found.select("_id", "_row_name", "_sha", *more, F.coalesce("_stay", alone).alias("_stay"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def _told_apart(cut: DataFrame, distinct: DataFrame, shared: DataFrame, name_of: Callable[[Column], Column]) -> DataFrame:
    """Recipes of names and turns: chunks that share a name are told apart by their turn among the texts of that name."""
    turns = distinct.join(shared, "_name", "left_semi").withColumn("_turn", F.row_number().over(Window.partitionBy("_name").orderBy("_chunk")))
    rows = cut_lineage(cut.withColumn("_row", F.monotonically_increasing_id()))
    flat = rows.select("_row", F.posexplode("_chunks").alias("_pos", "_chunk")).withColumn("_name", name_of(F.col("_chunk")))
    found = flat.join(turns, ["_name", "_chunk"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_turn"))).alias("_turns"))
    named = F.flatten(F.transform("_chunks", lambda c, i: F.array(name_of(c), F.coalesce(F.col("_turns")[i], F.lit(0)).cast("long"))))
    return rows.join(found, "_row", "left").select("_id", "_row_name", "_chars", named.alias("_recipe"), F.sha2("_norm", 256).alias("_sha"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each group of equal texts, with all its columns: of the most code points, then the least id.

    A null text is an empty one, all of these are one group; a null id comes after all others. Of rows equal in id and
    text one stays. An empty table gives an empty result; names of columns are free.
    """
    name = row_name(id_col, text_col)
    rows = _decided(docs.select(F.col(id_col).alias("_id"), name.alias("_row_name"), F.col(text_col).alias("_doc")))
    told = rows.groupBy("_row_name", (F.col("_row_name") == F.col("_stay.r")).alias("_stays")).agg(F.count(F.lit(1)).alias("_n"))
    told = cut_lineage(told.filter("NOT _stays OR _n > 1"))
    named = packed(docs, name.alias("_row_name"))
    left = join_side(named, told.select("_row_name"), "_row_name", "left_anti", F.lit(96))
    again = told.filter("_stays").select("_row_name")
    if not again.isEmpty():
        # rows equal in id and text share a name, and one of them stays
        left = left.unionByName(join_side(named, again, "_row_name", "left_semi", F.lit(96)).dropDuplicates(["_row_name"]))
    return left.select("row.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
      count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept, text_sha256 FROM r""",
}

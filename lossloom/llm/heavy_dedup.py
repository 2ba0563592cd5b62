"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries summary names the digests that may be frequent, an exact count over those alone verifies them, and their
winners, at most ``SHARE`` rows, are broadcast: rows of frequent texts are settled where they are read. All other digests
are shuffled. Only DataFrame functions are used.

The summary is Spark's frequent-items sketch: a Misra-Gries counter table that, when full, takes the median counter off all
of them. One is built per input task, partial ones are merged by groups of tasks and then into one. With ``TRACKED`` counters
an item is off by at most 3.5 / TRACKED of all rows, so every digest with more than 1 / SHARE of them is found; what the
sketch names beside these is dropped by the exact count. A digest that is missed or dropped is merely shuffled.

Nulls count as empty texts. Rows of one doc_id with different texts are different documents. Of rows that repeat a doc_id and
a text one stays; a null doc_id is the smallest. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import shuffle_parts, stage, text_or_empty

SHARE = 1000  # digests with more than a 1/SHARE share of the rows are broadcast: there can be no more than SHARE of them
TRACKED = 8192  # counters of the summary

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII only take the shorter way of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(fold_ascii(text), 256))


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, a hash of the text as it is, and a number of its own for every row: texts are read once, here."""
    whole = text_or_empty(text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), digest(whole).alias("digest"), F.xxhash64(whole).alias("raw"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(rows, "digests")


def frequent_keys(rows: DataFrame) -> DataFrame:
    """64-bit keys of the digests that the Misra-Gries summary holds for frequent, and the rows of each by its count."""
    tasks = F.pmod(F.spark_partition_id(), F.lit(shuffle_parts(rows.sparkSession)))
    parts = rows.groupBy(tasks.alias("_task")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {TRACKED})").alias("_summary"))
    whole = parts.groupBy(F.lit("all").alias("_all")).agg(F.expr(f"approx_top_k_combine(_summary, {TRACKED})").alias("_summary"))
    found = whole.select(F.inline(F.expr(f"approx_top_k_estimate(_summary, {2 * SHARE})")))
    return found.select(F.col("item").alias("key"), F.col("count").alias("about"))


def winners(rows: DataFrame) -> DataFrame:
    """digest, group_size and the row that stays, for every digest with more than one row and more than 1/SHARE of all.

    Counted over whole digests and all rows, so a key shared by chance or named in error does no harm.
    """
    keys = F.broadcast(frequent_keys(rows).select("key"))
    counted = rows.join(keys, F.xxhash64("digest") == F.col("key"), "left_semi").groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "raw", "row")).alias("winner")
    )
    least = max(1, rows.count() // SHARE)
    return stage(counted.where(F.col("group_size") > least), "winners")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 (of the text with A-Z in lower case)."""
    rows = digest_rows(docs, doc_id, text)
    tagged = rows.join(F.broadcast(winners(rows)), "digest", "left")
    group = Window.partitionBy("digest")
    rest = tagged.where("winner is null").select(
        "digest", "doc_id", "raw", "row", F.count("*").over(group).alias("group_size"), F.max(F.struct("doc_id", "raw", "row")).over(group).alias("winner")
    )
    settled = tagged.where("winner is not null").select(rest.columns).unionByName(rest)
    return settled.select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest doc_id.

    Losers of frequent texts go before the shuffle. Where rows repeat both doc_id and text, the one whose text as written has
    the largest hash stays, and Spark keeps one such row per task before it shuffles, so no group is gathered.
    """
    found = winners(digest_rows(docs, doc_id, text)).select(F.col("digest").alias("_of"), "winner")
    whole = F.col(f"_row.{text}")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = rows.select("_row", F.col(f"_row.{doc_id}").cast("long").alias("_id"), F.coalesce(whole.cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("_row", "_id", digest(F.col("_text")).alias("_digest"), F.xxhash64("_text").alias("_raw"))
    rows = rows.join(F.broadcast(found), F.col("_digest") == F.col("_of"), "left")
    first = F.col("winner").isNull() | (F.col("_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("_raw") == F.col("winner.raw")))
    order = Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last(), F.col("_raw").desc())
    return rows.where(first).withColumn("_place", F.row_number().over(order)).where("_place = 1").select("_row.*")


def duplicate_groups_sql() -> str:
    return f"""
    with hashed as (select doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) as h from documents)
    select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
      doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256 from hashed
    """

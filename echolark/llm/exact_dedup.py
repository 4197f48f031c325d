r"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text, A-Z lower-cased, is cut into chunks where its content says so: after CHUNK_MIN characters,
at the first place behind a letter pair and space that occurs about once in a kilobyte, and after
CHUNK_MAX at the latest. Chunks are deduplicated over the whole corpus: chunks of one SHA-256 get one
identifier, a number given to each different chunk that occurs twice or more. A document with a chunk of its own has
no copy; of every other document the ordered list of identifiers is its recipe, and documents of equal
recipes are copies. The SHA-256 of the whole texts only confirms that: a group of equal recipes and
different texts is an error, not a group. Texts are read once and not shuffled to find the classes;
digests of chunks, a twentieth of their size, are.

Defined cases: null counts as empty, and all empty texts are equal; of equal texts the row with the
largest id stays, a null id being the smallest; rows that repeat an id and a text stay once; texts of
any length are cut by one pass; other columns, whatever their names, pass through `drop_copies`; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, field, own_columns, scratch, staged

CHUNK_MIN, CHUNK_MAX = 256, 4096
CHUNK = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?(?:(?<=[aeiourst] [a-m][a-z])|\z)|.{{1,{CHUNK_MAX}}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond ASCII that lower() would change.
OTHER_UPPER = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() where it gives the same, as it is much faster."""
    return F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def with_recipes(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df's columns (without the text, if that is not kept) as the struct doc, staged with a row number,
    the chunks' digests and the text's."""
    norm = ascii_lower(F.coalesce(df[f"`{text}`"], F.lit("")))
    own = df.select(own_columns(df, but=() if keep_text else (text,)), F.monotonically_increasing_id().alias("row"), norm.alias("norm"))
    own = own.withColumn("chunks", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)))
    digests = F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256)))
    return staged(own.select("doc", "row", digests.alias("digests"), F.sha2("norm", 256).alias("text_sha256")))


def chunk_dictionary(chunks: DataFrame) -> DataFrame:
    """(digest, id) of chunks (row, at, n, digest): an identifier for each different chunk that occurs
    twice or more."""
    found = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return staged(found.select("digest", F.monotonically_increasing_id().alias("id")))


def recipes(rows: DataFrame) -> DataFrame:
    """(row, recipe) of the rows that can have a copy: those without a chunk that occurs once."""
    chunks = rows.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("at", "digest"))
    named = chunks.join(chunk_dictionary(chunks), "digest")
    lists = named.groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("held")).where(F.size("held") == F.col("n"))
    empty = rows.where(F.size("digests") == 0).select("row", F.array().cast("array<bigint>").alias("recipe"))
    return staged(lists.select("row", F.transform("held", lambda x: x.id).alias("recipe")).union(empty))


def classes(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, text_sha256, keep_id, group_size, kept) of rows from with_recipes(). A large group
    is many rows of one join key, which Spark's skew join splits."""
    own = rows.select("row", F.col(field("doc", doc_id)).alias("doc_id"), "text_sha256")
    with scratch(rows.sparkSession):
        known = staged(recipes(rows).join(own, "row"))
        last = F.max(F.struct("doc_id", "row")).alias("last")
        groups = known.groupBy("recipe").agg(last, F.count(F.lit(1)).alias("group_size"), F.min("text_sha256").alias("s0"), F.max("text_sha256").alias("s1"))
        agree = F.when(F.col("s0") == F.col("s1"), F.col("group_size")).otherwise(F.raise_error(F.lit("equal recipes of different texts")).cast("long"))
        groups = staged(groups.where(F.col("group_size") > 1).select("recipe", "last", agree.alias("group_size")))
        members = staged(known.join(groups, "recipe").select("row", "last", "group_size"), keep=True)
    found = own.join(members, "row", "left")
    keep = F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id"))
    kept = F.coalesce(F.col("last.row") == F.col("row"), F.lit(True))
    return found.select("row", "doc_id", "text_sha256", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one of each group of equal texts. Texts stay where they are unless more
    rows go than may be broadcast; then they are shuffled once."""
    rows = with_recipes(docs, text)
    dropped = staged(classes(rows, doc_id).where(~F.col("kept")).select("row"))
    return rows.join(broadcast_if_small(dropped), "row", "left_anti").select("doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its group of equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(with_recipes(docs, keep_text=False)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


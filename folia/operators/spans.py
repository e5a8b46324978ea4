"""The canonical projection of plain texts to layout rows: lines, tokens, pages.

A line is 14 points below the one before it, 48 to a page; a character is 6
points wide; the first line is a bold title. Everything else (rows, words,
tables, reading order) is derived from these tables in the same way as from
spans of real pages, which have the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_LINES, PITCH, CHAR, LEFT, TOP = 48, 14, 6, 72, 720


def spread_out(rows: DataFrame) -> DataFrame:
    """A small scan dealt to all cores: one file of one row group would keep one busy. Scans with a split a core stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows._jdf.queryExecution().toRdd().getNumPartitions() < 2 * cores
    return rows.repartition(cores) if few else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page, line_no (from 0), line, y, size, bold of every line of a text."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.select(
        "doc_id", (F.floor(F.col("line_no") / PAGE_LINES) + 1).cast("int").alias("page"), "line_no", "line", (TOP - PITCH * (F.col("line_no") % PAGE_LINES)).alias("y"),
        F.when(F.col("line_no") == 0, 18).otherwise(12).alias("size"), (F.col("line_no") == 0).alias("bold"),
    )


def tokens(docs: DataFrame) -> DataFrame:
    """Lines' columns (but the text) with tok_no, token, x0, x1 of every non-empty token."""
    parts = lines(docs).select("doc_id", "page", "line_no", "y", "size", "bold", F.posexplode(F.split("line", " ", -1)).alias("part_no", "token"))
    upto = W.partitionBy("doc_id", "line_no").orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    x0 = LEFT + CHAR * F.coalesce(F.sum(F.length("token") + 1).over(upto), F.lit(0))
    placed = parts.withColumn("x0", x0).filter("token <> ''").withColumn("x1", F.col("x0") + CHAR * F.length("token"))
    number = F.row_number().over(W.partitionBy("doc_id", "line_no").orderBy("part_no")) - 1
    return placed.withColumn("tok_no", number).drop("part_no")


def page_md(docs: DataFrame) -> DataFrame:
    """doc_id, page, chunk: the page's lines joined. Pages are cut within a document's row, so nothing is shuffled."""
    rows = docs.select("doc_id", F.split("text", "\n", -1).alias("ls"))
    pages = F.sequence(F.lit(1), F.ceil(F.size("ls") / PAGE_LINES).cast("int"))
    rows = rows.select("doc_id", "ls", F.explode(pages).alias("page"))
    return rows.select("doc_id", "page", F.array_join(F.slice("ls", (F.col("page") - 1) * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n").alias("chunk"))


#: The same tables as common table expressions.
SQL_LINES = f"""
ln as (select doc_id, cast(floor(line_no / {PAGE_LINES}.0) + 1 as int) as page, line_no, line, {TOP} - {PITCH} * (line_no % {PAGE_LINES}) as y, case when line_no = 0 then 18 else 12 end as size, line_no = 0 as bold
 from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents) a)"""
SQL_TOKENS = f"""{SQL_LINES},
pt as (select doc_id, page, line_no, y, size, bold, unnest(string_split(line, ' ')) as token, generate_subscripts(string_split(line, ' '), 1) as part_no from ln),
px as (select *, cast({LEFT} + {CHAR} * coalesce(sum(length(token) + 1) over (partition by doc_id, line_no order by part_no rows between unbounded preceding and 1 preceding), 0) as bigint) as x0 from pt),
tk as (select doc_id, page, line_no, y, size, bold, token, x0, x0 + {CHAR} * length(token) as x1, row_number() over (partition by doc_id, line_no order by part_no) - 1 as tok_no from px where token <> '')"""


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(spark: SparkSession, texts: list[str]) -> DataFrame:
    """id and text of literal samples."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("id", "text"))


def sql_values(texts: list[str]) -> str:
    """The same as a SQL row source."""
    listed = ", ".join(f"({i}, {literal(t)})" for i, t in enumerate(texts))
    return f"(values {listed}) as v(id, text)"

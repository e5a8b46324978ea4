"""Ways in: SQL functions, tables from JSON spans, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions.reflow import collapse, reflow
from folia.operators.canvas import canvas_tables, first_row_is_header, gfm
from folia.operators.pictures import phash_udf
from folia.plans.convert import Options, convert
from folia.sources.pdf_objects import PdfError, password_required
from folia.sources.pdf_pages import is_digital, read_pages

SPANS_JSON = "array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,font_size:double,is_bold:boolean,is_italic:boolean,page_number:int>>"


class PdfSpans:
    """Table function: the positioned spans of a file's bytes; nothing for one that can't be read."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            for _, page in read_pages(bytes(content or b"")):
                for k, s in enumerate(page.spans):
                    yield page.number, k, s["text"], s["x"], s["y"], s["size"], s["advance"], s["bold"], s["italic"], s["vertical"]
        except PdfError:
            return


def _map(f, kind: T.DataType):
    """A scalar function over Arrow batches; nulls stay null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


def register(spark: SparkSession) -> None:
    """The engine's functions for SQL: pdf_is_digital, pdf_password_required, pdf_spans, picture_hash, markdown_reflow, markdown_collapse."""
    spark.udf.register("pdf_is_digital", _map(lambda b: is_digital(bytes(b)), T.BooleanType()))
    spark.udf.register("pdf_password_required", _map(lambda b: password_required(bytes(b)), T.BooleanType()))
    spark.udf.register("picture_hash", phash_udf)
    spark.udf.register("markdown_reflow", _map(reflow, T.StringType()))
    spark.udf.register("markdown_collapse", _map(collapse, T.StringType()))
    made = F.udtf(PdfSpans, returnType="page int, seq int, text string, x double, y double, size double, advance double, bold boolean, italic boolean, vertical boolean")
    spark.udtf.register("pdf_spans", made)


def tables_from_json(rows: DataFrame) -> DataFrame:
    """id and markdown of the table in each row's spans_json (an array of spans); '' without one, null for no JSON."""
    spans = rows.select("id", F.posexplode(F.from_json("spans_json", SPANS_JSON)).alias("seq", "s"))
    flat = spans.select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), "seq", F.col("s.text").alias("text"), *[F.col(f"s.bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    made = canvas_tables(flat).select("doc_id", gfm(F.col("rows"), first_row_is_header(F.col("rows"))).alias("markdown"))
    out = rows.join(made, rows["id"] == made["doc_id"], "left")
    valid = F.from_json("spans_json", SPANS_JSON).isNotNull()
    return out.select("id", F.when(valid, F.coalesce("markdown", F.lit(""))).alias("markdown"))


def main(argv: list[str] | None = None) -> int:
    """Convert one file; 1: it can't be read or written, 2: it shows no text, 3: it can't be converted."""
    p = argparse.ArgumentParser(prog="folia", description="A document with a text layer to Markdown.")
    p.add_argument("input", help="file, or - for standard input")
    p.add_argument("-o", "--output", help="file for the result (default: standard output)")
    p.add_argument("--json", action="store_true", help="the whole result as JSON")
    p.add_argument("--no-tables", action="store_true")
    p.add_argument("--page-markers", action="store_true")
    p.add_argument("--vectors", action="store_true", help="drawn figures are media too")
    p.add_argument("--media-mode", choices=("none", "reference", "embed"), default="none")
    p.add_argument("--embed-media", dest="media_mode", action="store_const", const="embed")
    p.add_argument("--no-media", dest="media_mode", action="store_const", const="none")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(argv)
    say = (lambda *x: None) if a.quiet else (lambda *x: print(*x, file=sys.stderr))
    try:
        if a.input == "-":
            data = sys.stdin.buffer.read()
        else:
            with open(a.input, "rb") as f:
                data = f.read()
    except OSError as x:
        say(x)
        return 1
    if password_required(data):
        say("a password is required")
        return 3
    if not is_digital(data):
        say("no text layer")
        return 2
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
    files = spark.createDataFrame([("input", bytearray(data))], "doc_id string, content binary")
    [row] = convert(files, Options(tables=not a.no_tables, page_markers=a.page_markers, media=a.media_mode, vectors=a.vectors)).collect()
    if not row["ok"] or row["needs_vision_rescue"]:
        say(row["error"] or row["rescue_reason"])
        return 3
    text = json.dumps(row.asDict(True), default=lambda b: bytes(b).hex(), ensure_ascii=False, indent=1) if a.json else row["markdown"]
    try:
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    except OSError as x:
        say(x)
        return 1
    return 0

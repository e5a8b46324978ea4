"""Tables on a canvas of spans, and their rendering as pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.predicates import is_value_cell, md_cell, trim
from folia.operators.sequence import anchored
from folia.operators.spans import SQL_TOKENS, documents, table, tokens

Y_TOLERANCE = 3.0


def first_row_is_header(rows: Column) -> Column:
    """False for a label/value grid: a label in row 0 and a column that holds a value there and values or nothing elsewhere."""
    first = F.get(rows, 0)
    width = F.array_max(F.transform(rows, F.size))
    label = F.exists(first, lambda c: (trim(c) != "") & ~is_value_cell(c))

    def value_column(k: Column) -> Column:
        here = is_value_cell(F.coalesce(F.get(first, k), F.lit("")))
        cell = lambda r: F.coalesce(F.get(r, k), F.lit(""))
        return here & F.forall(rows, lambda r: (trim(cell(r)) == "") | is_value_cell(cell(r)))

    return (F.size(rows) < 2) | ~(label & F.exists(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), value_column))


def gfm(rows: Column, header: Column, alignments: Column | None = None) -> Column:
    """A pipe table; without a header the first line is blank. ``alignments``: left, right or center by column."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    cols = F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))

    def line(r: Column) -> Column:
        return F.concat(F.lit("|"), F.array_join(F.transform(cols, lambda k: F.concat(F.lit(" "), md_cell(F.coalesce(F.get(r, k), F.lit(""))), F.lit(" |"))), ""), F.lit("\n"))

    rule = lambda k: F.lit(" --- |")
    if alignments is not None:
        rule = lambda k: F.when(F.get(alignments, k) == "right", " ---: |").when(F.get(alignments, k) == "center", " :---: |").when(F.get(alignments, k) == "left", " :--- |").otherwise(" --- |")
    head = F.when(header, line(F.get(rows, 0))).otherwise(line(F.array(F.lit(""))))
    body = F.transform(F.slice(rows, F.when(header, 2).otherwise(1), F.size(rows)), line)
    rule_line = F.concat(F.lit("|"), F.array_join(F.transform(cols, rule), ""), F.lit("\n"))
    return F.when(width == 0, "").otherwise(F.concat(head, rule_line, F.array_join(body, "")))


def canvas_tables(spans: DataFrame) -> DataFrame:
    """One table a page of its rows with at least two spans, if there are two such rows and four spans.

    ``spans`` has doc_id, page, seq, text, x0, y0, x1, y1.
    """
    page = ["doc_id", "page"]
    rows = anchored(spans.select(*page, "seq", "text", "x0", "y0", "x1", "y1"), page, [F.desc("y0"), F.col("x0"), F.col("seq")], "y0", Y_TOLERANCE, "row_no")
    cells = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("down"), "x0", "seq", "text"))), lambda c: c["text"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    made = rows.groupBy(*page, "row_no").agg(cells.alias("cells"), *box)
    grid = F.transform(F.array_sort(F.collect_list(F.when(F.size("cells") >= 2, F.struct("row_no", "cells")))), lambda r: r["cells"])
    out = made.groupBy(*page).agg(grid.alias("rows"), F.sum(F.size("cells")).alias("n_spans"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.filter("n_spans >= 4 and size(rows) >= 2")


def _token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokens(documents(spark, sf_dir))
    y = F.col("y").cast("double")
    return tok.select("doc_id", "page", (F.col("line_no") * 100000 + F.col("tok_no")).alias("seq"), F.col("token").alias("text"), "x0", y.alias("y0"), "x1", (y + F.col("size")).alias("y1"))


def canvas_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent and shape of each page's canvas table."""
    out = canvas_tables(_token_spans(spark, sf_dir))
    return out.select("doc_id", "page", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("n_cols"), "n_spans", "x0", "y0", "x1", "y1", first_row_is_header(F.col("rows")).alias("header"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the corpus with their canvas table in Markdown."""
    out = canvas_tables(_token_spans(spark, sf_dir))
    return out.select("doc_id", "page", gfm(F.col("rows"), first_row_is_header(F.col("rows"))).alias("markdown"))


def gfm_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table of the nations of each region, with aligned columns."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # 5 rows by definition
    cells = F.array("n_name", F.col("n_nationkey").cast("string"), F.concat("r_name", F.lit(" | "), F.length("n_name").cast("string"), F.lit("%")))
    grid = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda r: r["c"])
    out = rows.groupBy("r_regionkey").agg(grid.alias("rows"))
    head = first_row_is_header(F.col("rows"))
    align = F.array(F.lit("left"), F.lit("right"), F.lit("center"))
    return out.select("r_regionkey", head.alias("header"), gfm(F.col("rows"), head, align).alias("markdown"))


def order_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header test over the line items of each order as a grid with a label column."""
    items = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_linenumber").cast("string"))
    value = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2), F.col("l_linestatus")).otherwise(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" €")))
    grid = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(label, value).alias("c")))), lambda r: r["c"])
    out = items.groupBy("l_orderkey").agg(grid.alias("rows"))
    return out.groupBy(first_row_is_header(F.col("rows")).alias("header"), F.size("rows").alias("n_rows")).agg(F.count("*").alias("n"))


_V = "regexp_matches(regexp_replace(regexp_replace({0}, '^[€$£ ]+', ''), '[€$£ ]+$', ''), '^[-0-9.,+%/'' ]*[0-9][-0-9.,+%/'' ]*$')"
_CANVAS = f"""{SQL_TOKENS},
rw as (select doc_id, page, line_no, y, count(*) as n, string_agg(token, chr(1) order by tok_no) as cells, min(x0) as x0, max(x1) as x1, max(size) as size from tk group by doc_id, page, line_no, y),
pg as (select doc_id, page, count(*) filter (where n >= 2) as n_rows, max(n) as n_cols, sum(n) as n_spans, min(x0) as x0, min(y)::double as y0, max(x1) as x1, max(y + size)::double as y1, min(line_no) filter (where n >= 2) as first_line from rw group by doc_id, page having sum(n) >= 4 and count(*) filter (where n >= 2) >= 2),
cl as (select t.doc_id, t.page, t.line_no, t.tok_no, t.token, {_V.format('t.token')} as v, t.line_no = pg.first_line as top from tk t join pg using (doc_id, page) join rw on rw.doc_id = t.doc_id and rw.page = t.page and rw.line_no = t.line_no and rw.n >= 2),
co as (select doc_id, page, tok_no, bool_or(top and v) and bool_and(v) as valued from cl group by doc_id, page, tok_no),
hd as (select c.doc_id, c.page, not (c.label and o.valued) as header from (select doc_id, page, bool_or(top and not v) as label from cl group by doc_id, page) c join (select doc_id, page, bool_or(valued) as valued from co group by doc_id, page) o using (doc_id, page))"""
_ESC = "regexp_replace({0}, '([|\\\\])', '\\\\\\1', 'g')"

QUERIES = {f.__name__: f for f in (canvas_rows, flagship, gfm_nations, order_grids)}
ORACLES = {
    "canvas_rows": f"with {_CANVAS} select doc_id, page, n_rows, n_cols, n_spans, x0, y0, x1, y1, header from pg join hd using (doc_id, page)",
    "flagship": f"""with {_CANVAS},
ml as (select r.doc_id, r.page, r.line_no, '|' || string_agg(' ' || {_ESC.format("coalesce(t.token, ' ')")} || ' |', '' order by k.k) || chr(10) as line from rw r join pg using (doc_id, page), lateral (select unnest(range(0, pg.n_cols)) as k) k
 left join tk t on t.doc_id = r.doc_id and t.line_no = r.line_no and t.tok_no = k.k where r.n >= 2 group by r.doc_id, r.page, r.line_no)
select doc_id, page, case when header then any_value(fl) || rule || coalesce(string_agg(line, '' order by line_no) filter (where line_no > first_line), '') else '|' || repeat('   |', n_cols::int) || chr(10) || rule || string_agg(line, '' order by line_no) end as markdown
from (select ml.*, pg.n_cols, pg.first_line, hd.header, '|' || repeat(' --- |', pg.n_cols::int) || chr(10) as rule, max(case when ml.line_no = pg.first_line then line end) over (partition by ml.doc_id, ml.page) as fl from ml join pg using (doc_id, page) join hd using (doc_id, page)) x
group by doc_id, page, header, rule, n_cols, first_line""",
    "gfm_nations": """with r as (select r_regionkey, n_nationkey, '| ' || n_name || ' | ' || n_nationkey || ' | ' || r_name || ' \\| ' || length(n_name) || '% |' || chr(10) as line from nation join region on n_regionkey = r_regionkey)
select r_regionkey, false as header, '|   |   |   |' || chr(10) || '| :--- | ---: | :---: |' || chr(10) || string_agg(line, '' order by n_nationkey) as markdown from r group by r_regionkey""",
    "order_grids": """with c as (select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then l_returnflag else l_linenumber::varchar end as a, case when l_orderkey % 5 = 0 and l_linenumber = 2 then l_linestatus else l_quantity::bigint || ' €' end as b from lineitem),
o as (select l_orderkey, count(*) as n_rows, bool_and(regexp_matches(a, '^[0-9]')) as a_all, bool_and(regexp_matches(b, '^[0-9]')) as b_all, min_by(regexp_matches(a, '^[0-9]'), l_linenumber) as a0, min_by(regexp_matches(b, '^[0-9]'), l_linenumber) as b0 from c group by l_orderkey)
select n_rows < 2 or not ((not a0 or not b0) and ((a0 and a_all) or (b0 and b_all))) as header, n_rows, count(*) as n from o group by all""",
}

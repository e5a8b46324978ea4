"""Choices by page and line: which text wins, splits of rows, roles of tags, what is lost between two readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import predicates as p
from folia.operators.sequence import DOC_LINE, PAGE, lagged, spread, upper_median
from folia.operators.spans import SQL_LINES, SQL_TOKENS, documents, lines, literal, sql_values, table, tokens, values

ROLES = ["H", "H1", "H3", "H9", "P", "L", "LI", "LBody", "Table", "TR", "Figure", "Fig", "Header", "Foot", "TOC", "Span", "Custom", ""]
EMPHASIS = ["**bold**", "<u>under</u>", "*it*", "<u>**both**</u>", "<u>a</u> <u>b</u>", "**a** **b**", "plain", "***all***", "** x **", "<u></u>", "*"]
MARKS = ["[3]", "2.", "12)", "(4)", "123456.", "[a]", "(12345)", "7", ".", "[12] x"]
CELLS = ["short", "one. two! three four five six seven eight", "no stop here but a lot of words that go on and on until there are twenty of them in this one cell now", "A. B.", "", "a. b c d e f g h. i"]
NUMBER_LINES = ["3", "12/14", "- 7 -", "page 3", "1234567890123", "4.", "", "12", "123"]


def heading_of_role(role: Column) -> Column:
    """1 for H, n for Hn within 1 to 6; null for other roles."""
    return F.when(role == "H", 1).when(role.rlike("^H[0-9]$"), F.least(F.greatest(F.substring(role, 2, 1).try_cast("int"), F.lit(1)), F.lit(6)))


def kind_of_role(role: Column) -> Column:
    """Block kind of a structure role."""
    return (
        F.when(role.rlike("^H[1-6]?$"), "heading").when(role.isin("L", "LI", "UL", "OL", "LBody"), "list").when(role == "Table", "table")
        .when(role.isin("Figure", "Fig"), "figure").when(role.isin("Header", "Head"), "header").when(role.isin("Footer", "Foot"), "footer").when(role == "TOC", "toc").otherwise("body")
    )


def strip_emphasis(text: Column, rounds: int = 4) -> Column:
    """Without up to four wrappers that span the whole text."""

    def once(t: Column, _: Column) -> Column:
        made = t
        for a, z in (("*", "*"), ("**", "**"), ("<u>", "</u>")):
            inner = F.substring(t, len(a) + 1, F.length(t) - len(a + z))
            whole = (F.length(t) >= len(a + z)) & t.startswith(a) & t.endswith(z) & ~F.contains(inner, F.lit(z))
            made = F.when(whole, p.trim(inner)).otherwise(made)
        return made

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p.trim(text), once)


def ordinal(token: Column) -> Column:
    """Number of a list or citation mark; null if it is none."""
    bracket, dot = r"^\[([0-9]{1,9})\]$", r"^\(?([0-9]{1,9})[.)]$"
    return F.when(token.rlike(bracket), F.regexp_extract(token, bracket, 1).try_cast("int")).when(token.rlike(dot) & (F.octet_length(token) <= 5), F.regexp_extract(token, dot, 1).try_cast("int"))


def flows(cell: Column) -> Column:
    """A cell that reads as prose: twenty words, or eight with two sentence ends."""
    n = p.word_count(cell)
    return (n >= 20) | ((n >= 8) & (F.length(F.regexp_replace(cell, "[^.!?]", "")) >= 2))


def loses_digits(first: Column, second: Column) -> Column:
    """Whether a grouped number of three digits or more in one text is missing from the digits of another."""
    seen = F.regexp_replace(second, "[^0-9]+", "")
    found = F.regexp_extract_all(first, F.lit(r"([0-9](?:[ \x{00A0}\x{202F}'.,]?[0-9])*)"), F.lit(1))
    digits = F.transform(found, lambda v: F.regexp_replace(v, "[^0-9]+", ""))
    return F.exists(digits, lambda v: (F.length(v) >= 3) & ~F.contains(seen, v))


def route(shows: Column, arrays: Column, quotes: Column, moves: Column, sets: Column, level: Column, tables: bool = True) -> Column:
    """geometry or strings for a page, by what its contents use: shows, show arrays, quotes, Td moves, Tm/TD sets, level moves."""
    if not tables:
        return F.when((arrays > 0) & (shows == 0) & (sets > 0), "geometry").otherwise("strings")
    any_show = (shows > 0) | (arrays > 0)
    return F.when(any_show & (sets > 0), "geometry").when((any_show | (quotes > 0)) & (moves >= 2) & (2 * level >= moves), "geometry").otherwise("strings")


def row_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest gap over 1.2 em of each row with two words before it, and the page's median gutter."""
    rows = spread(spark, sf_dir).withColumn("gap", F.col("x0") - lagged("x1", DOC_LINE, [F.col("x0")]))
    cut = rows.filter((F.col("gap") > 1.2 * F.col("size")) & (F.col("tok_no") >= 2)).groupBy(*PAGE, "line_no").agg(F.max(F.struct("gap", (-F.col("x0")).alias("k"))).alias("b"))
    cut = cut.select(*PAGE, "line_no", (-F.col("b.k") - F.col("b.gap") / 2).alias("gutter"))
    return cut.groupBy(*PAGE).agg(F.count("*").alias("n_rows"), upper_median(F.collect_list("gutter")).alias("median_gutter"))


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of pages whose operator counts are taken from orders."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[(k % n).cast("int").alias(c) for c, n in (("shows", 3), ("arrays", 2), ("quotes", 5), ("moves", 7), ("sets", 4), ("level", 6))])
    cols = [F.col(c) for c in ("shows", "arrays", "quotes", "moves", "sets", "level")]
    return rows.select("o_orderkey", route(*cols).alias("with_tables"), route(*cols, tables=False).alias("without"))


def text_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading that wins for pages with word counts taken from customers, the glyph note and the status of lost pages."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (k % 40).cast("int").alias("tagged"), (k % 47).cast("int").alias("layout"), (k % 5).cast("int").alias("bad"), (k % 100).cast("int").alias("good"))
    tagged = (F.col("tagged") >= 5) & (F.col("tagged") * 100 >= 85 * F.col("layout"))
    note = F.when((F.col("bad") > 0) & (F.col("layout") > 0), F.format_string("<!-- %d of %d glyphs could not be decoded -->", F.col("bad"), F.col("bad") + F.col("good")))
    return rows.select("c_custkey", F.when(tagged, "tagged").otherwise("layout").alias("choice"), note.alias("note"), F.when((F.col("layout") == 0) & (F.col("bad") > 0), "GlyphEncoded").alias("rescue"))


def lost_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose numbers are lost if only their first half is kept."""
    rows = lines(documents(spark, sf_dir)).withColumn("line", F.concat("line", F.lit(" 12 345,00 "), F.col("line_no").cast("string")))
    kept = F.substring("line", F.lit(1), F.floor(F.length("line") / F.when(F.col("line_no") % 2 == 0, 1).otherwise(2)).cast("int"))
    return rows.groupBy("doc_id").agg(F.count_if(loses_digits(F.col("line"), kept)).alias("n_lost"), F.count("*").alias("n_lines"))


def tag_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, ROLES).select("id", kind_of_role(F.col("text")).alias("kind"), heading_of_role(F.col("text")).alias("level"))


def stripped_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, EMPHASIS).select("id", strip_emphasis(F.col("text")).alias("bare"))


def mark_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, MARKS).select("id", ordinal(F.col("text")).alias("number"))


def prose_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, CELLS).select("id", flows(F.col("text")).alias("flows"))


def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of digits in the lowest 5.5 per cent of a page (y 30 of 792 for odd ids)."""
    y = F.when(F.col("id") % 2 == 1, 30.0).otherwise(60.0)
    return values(spark, NUMBER_LINES).select("id", ((y < 0.055 * 792) & F.col("text").rlike(p.PAGE_NUMBER) & (F.octet_length("text") <= 12)).alias("number"), ((y < 0.055 * 792) & F.col("text").rlike("^[0-9]{1,2}$")).alias("bare"))


def straightened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line starts of each page turned by two degrees about their centre and back."""
    pts = tokens(documents(spark, sf_dir)).filter("tok_no = 0").select(*PAGE, "line_no", F.col("x0").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    w = W.partitionBy(*PAGE)
    c, s = math.cos(math.radians(2)), math.sin(math.radians(2))
    dx, dy = F.col("x") - F.avg("x").over(w), F.col("y") - F.avg("y").over(w)
    turned = pts.select(*PAGE, "line_no", "x", "y", (dx * c - dy * s).alias("u"), (dx * s + dy * c).alias("v"))
    back = turned.select(*PAGE, F.abs(F.col("u") * c + F.col("v") * s - (F.col("x") - F.avg("x").over(w))).alias("e"), F.round("v", 3).alias("v"))
    return back.groupBy(*PAGE).agg((F.max("e") < 1e-9).alias("same"), F.max("v").alias("top"))


def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside the hits of their page: hits are runs of eight lines from every twentieth."""
    own = lines(documents(spark, sf_dir)).select("doc_id", "line_no")
    hits = own.filter("line_no % 20 = 3").select("doc_id", F.col("line_no").alias("first"), (F.col("line_no") + 7).alias("last"))
    # a hit covers a bounded run of lines: exploding it makes the interval anti-join an equi-join
    covered = hits.select("doc_id", F.explode(F.sequence("first", "last")).alias("line_no")).distinct()
    return own.join(covered, ["doc_id", "line_no"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


def glyph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded and undecodable codes of documents whose fonts are their lines: dingbats count for nothing, fonts without metrics two bytes a code."""
    rows = lines(documents(spark, sf_dir)).withColumn("font", F.get(F.array(F.lit("Helvetica"), F.lit("ZapfDingbats"), F.lit("NoMetrics")), (F.col("line_no") % 3).cast("int")))
    n = F.octet_length("line")
    return rows.groupBy("doc_id").agg(F.sum(F.when(F.col("font") == "Helvetica", n).otherwise(0)).alias("decoded"), F.sum(F.when(F.col("font") == "NoMetrics", F.ceil(n / 2)).otherwise(0)).alias("undecodable"))


def distinct_first_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with at least two distinct first words, and the share of vertical text if every fourth line stood upright."""
    tok = tokens(documents(spark, sf_dir))
    chars = F.length("token")
    tall = F.sum(F.when(F.col("line_no") % 4 == 1, chars).otherwise(0))
    return tok.groupBy(*PAGE).agg((F.countDistinct(F.when(F.col("tok_no") == 0, F.col("token"))) >= 2).alias("distinct"), (tall * 5 >= F.sum(chars) * 3).alias("rotate"))


_emph = "text"
for _ in range(4):
    _emph = f"(select case when length(q) >= 7 and starts_with(q, '<u>') and ends_with(q, '</u>') and not contains(substr(q, 4, length(q) - 7), '</u>') then trim(substr(q, 4, length(q) - 7)) when length(q) >= 4 and starts_with(q, '**') and ends_with(q, '**') and not contains(substr(q, 3, length(q) - 4), '**') then trim(substr(q, 3, length(q) - 4)) when length(q) >= 2 and starts_with(q, '*') and ends_with(q, '*') and not contains(substr(q, 2, length(q) - 2), '*') then trim(substr(q, 2, length(q) - 2)) else q end from (select {_emph} as q) z)"

QUERIES = {f.__name__: f for f in (row_splits, page_routes, text_choices, lost_digits, tag_roles, stripped_emphasis, mark_numbers, prose_cells, page_number_lines, straightened, covered_lines, glyph_totals, distinct_first_columns)}
_SPLIT = f"{SQL_TOKENS}, sp as (select doc_id, page, line_no, tok_no, size, x0 + cast(floor(tok_no / 3.0) as bigint) * 40 as x0, x1 + cast(floor(tok_no / 3.0) as bigint) * 40 as x1 from tk), g as (select *, x0 - lag(x1) over (partition by doc_id, line_no order by x0) as gap from sp), r as (select *, row_number() over (partition by doc_id, page, line_no order by gap desc, x0) as k from g where gap > 1.2 * size and tok_no >= 2)"
ORACLES = {
    "row_splits": f"with {_SPLIT} select doc_id, page, count(*) as n_rows, list_sort(list(x0 - gap / 2.0))[cast(floor(count(*) / 2.0) as int) + 1]::double as median_gutter from r where k = 1 group by doc_id, page",
    "page_routes": "select o_orderkey, case when (s > 0 or a > 0) and t > 0 then 'geometry' when (s > 0 or a > 0 or q > 0) and m >= 2 and 2 * l >= m then 'geometry' else 'strings' end as with_tables, case when a > 0 and s = 0 and t > 0 then 'geometry' else 'strings' end as without from (select o_orderkey, o_orderkey % 3 as s, o_orderkey % 2 as a, o_orderkey % 5 as q, o_orderkey % 7 as m, o_orderkey % 4 as t, o_orderkey % 6 as l from orders) x",
    "text_choices": "select c_custkey, case when t >= 5 and t * 100 >= 85 * l then 'tagged' else 'layout' end as choice, case when b > 0 and l > 0 then '<!-- ' || b || ' of ' || (b + g) || ' glyphs could not be decoded -->' end as note, case when l = 0 and b > 0 then 'GlyphEncoded' end as rescue from (select c_custkey, c_custkey % 40 as t, c_custkey % 47 as l, c_custkey % 5 as b, c_custkey % 100 as g from customer) x",
    "lost_digits": f"""with {SQL_LINES}, a as (select doc_id, line_no, line || ' 12 345,00 ' || line_no as line from ln), b as (select doc_id, regexp_extract_all(line, {literal("[0-9](?:[ " + chr(92) + "x{00A0}" + chr(92) + "x{202F}'.,]?[0-9])*")}) as found, regexp_replace(substr(line, 1, cast(floor(length(line) / case when line_no % 2 = 0 then 1.0 else 2.0 end) as int)), '[^0-9]+', '', 'g') as seen from a)
select doc_id, count(*) filter (where len(list_filter(found, lambda v: length(regexp_replace(v, '[^0-9]+', '', 'g')) >= 3 and not contains(seen, regexp_replace(v, '[^0-9]+', '', 'g')))) > 0) as n_lost, count(*) as n_lines from b group by doc_id""",
    "tag_roles": f"select id, case when text in ('H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6') then 'heading' when text in ('L', 'LI', 'UL', 'OL', 'LBody') then 'list' when text = 'Table' then 'table' when text in ('Figure', 'Fig') then 'figure' when text in ('Header', 'Head') then 'header' when text in ('Footer', 'Foot') then 'footer' when text = 'TOC' then 'toc' else 'body' end as kind, cast(case when text = 'H' then 1 when regexp_matches(text, '^H[0-9]$') then least(greatest(cast(substr(text, 2, 1) as int), 1), 6) end as int) as level from {sql_values(ROLES)}",
    "stripped_emphasis": f"select id, {_emph} as bare from {sql_values(EMPHASIS)}",
    "mark_numbers": f"select id, try_cast(case when regexp_matches(text, '^\\[[0-9]{{1,9}}\\]$') or (regexp_matches(text, '^\\(?[0-9]{{1,9}}[.)]$') and strlen(text) <= 5) then regexp_replace(text, '[^0-9]', '', 'g') end as int) as number from {sql_values(MARKS)}",
    "prose_cells": f"select id, n >= 20 or (n >= 8 and stops >= 2) as flows from (select id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n, length(regexp_replace(text, '[^.!?]', '', 'g')) as stops from {sql_values(CELLS)}) x",
    "page_number_lines": f"select id, id % 2 = 1 and regexp_matches(text, '^[0-9 /.-]+$') and strlen(text) <= 12 as number, id % 2 = 1 and regexp_matches(text, '^[0-9][0-9]?$') as bare from {sql_values(NUMBER_LINES)}",
    "straightened": f"with {SQL_TOKENS}, q as (select doc_id, page, x0 - avg(x0) over w as dx, y - avg(y) over w as dy from tk where tok_no = 0 window w as (partition by doc_id, page)) select doc_id, page, true as same, max(round(dx * {math.sin(math.radians(2))!r} + dy * {math.cos(math.radians(2))!r}, 3)) as top from q group by doc_id, page",
    "covered_lines": f"with {SQL_LINES}, h as (select doc_id, line_no as a, line_no + 7 as z from ln where line_no % 20 = 3) select doc_id, count(*) as n from ln where not exists (select 1 from h where h.doc_id = ln.doc_id and ln.line_no between h.a and h.z) group by doc_id",
    "glyph_totals": f"with {SQL_LINES} select doc_id, cast(sum(case when line_no % 3 = 0 then strlen(line) else 0 end) as bigint) as decoded, cast(sum(case when line_no % 3 = 2 then ceil(strlen(line) / 2.0) else 0 end) as bigint) as undecodable from ln group by doc_id",
    "distinct_first_columns": f"with {SQL_TOKENS} select doc_id, page, count(distinct case when tok_no = 0 then token end) >= 2 as \"distinct\", sum(case when line_no % 4 = 1 then length(token) else 0 end) * 5 >= sum(length(token)) * 3 as rotate from tk group by doc_id, page",
}

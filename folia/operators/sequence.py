"""Ordered-sequence operators: anchored groups, gaps and islands, running extremes, page statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions import predicates as p
from folia.operators.spans import SQL_LINES, SQL_TOKENS, documents, lines, tokens


def anchored(rows: DataFrame, keys: list[str], order: list[Column], value: str, tolerance: float, name: str) -> DataFrame:
    """Number groups of rows whose value stays within tolerance of the group's first value.

    Each group's anchor depends on the one before, which no window can express;
    rows stream through in order and only the anchor is held.
    """
    out = T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())])
    at = [rows.columns.index(k) for k in keys]
    v = rows.columns.index(value)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, n = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last != tuple(c[0] for c in cols)
            last = tuple(c[-1] for c in cols)
            x = batch.column(v).to_numpy(zero_copy_only=False).astype(float)
            made = np.empty(len(x), np.int32)
            stops = [*np.flatnonzero(new).tolist(), len(x)]
            if stops[0]:
                stops.insert(0, 0)
            for a, z in zip(stops, stops[1:]):
                if new[a]:
                    anchor, n = x[a], 0
                # rows up to the next one beyond the anchor's reach are one group
                while a < z:
                    far = np.flatnonzero(np.abs(x[a : min(z, a + 64)] - anchor) > tolerance)
                    if not len(far):
                        made[a : min(z, a + 64)] = n
                        a = min(z, a + 64)
                        continue
                    made[a : a + far[0]] = n
                    a += int(far[0])
                    anchor, n = x[a], n + 1
                    made[a] = n
                    a += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, name])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(number, out)


def islands(rows: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """Number runs: ``starts`` (over the keys' window, true or null at a run's first row) counts up."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w) - 1)


def lagged(value: str, keys: list[str], order: list[Column]) -> Column:
    return F.lag(value).over(W.partitionBy(*keys).orderBy(*order))


def running_max(value: str, keys: list[str], order: list[Column]) -> Column:
    """The largest value of all earlier rows."""
    return F.max(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted values: of an even number the higher middle one, of none null."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def intervals(rows: DataFrame, keys: list[str], lo: str, hi: str, gap: float) -> DataFrame:
    """Merged intervals of rows that overlap or lie within gap: keys, part, x0, x1, n."""
    order = [F.col(lo), F.col(hi)]
    starts = F.col(lo) > running_max(hi, keys, order) + gap
    return islands(rows, keys, order, starts, "part").groupBy(*keys, "part").agg(F.min(lo).alias("x0"), F.max(hi).alias("x1"), F.count("*").alias("n"))


DOC_LINE = ["doc_id", "line_no"]
PAGE = ["doc_id", "page"]
#: Tokens whose every third one is pushed right, so that lines have gutters.
SHIFT = 40


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    push = F.floor(F.col("tok_no") / 3) * SHIFT
    return tokens(documents(spark, sf_dir)).withColumns({"x0": F.col("x0") + push, "x1": F.col("x1") + push})


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at gaps over 2.5 em and 20 points."""
    rows = spread(spark, sf_dir)
    gap = F.col("x0") - lagged("x1", DOC_LINE, [F.col("x0")])
    rows = islands(rows, DOC_LINE, [F.col("x0")], (gap > 2.5 * F.col("size")) & (gap >= 20), "segment")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_no", "token"))), lambda t: t["token"]), " ")
    return rows.groupBy("doc_id", "line_no", "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"))


def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line whose gaps stay below 1.2 of its median gap and 10 points, as cells."""
    rows = spread(spark, sf_dir).withColumn("gap", F.col("x0") - lagged("x1", DOC_LINE, [F.col("x0")]))
    mid = rows.groupBy(*DOC_LINE).agg(upper_median(F.collect_list("gap")).alias("mid"))
    rows = rows.join(mid, DOC_LINE)
    rows = islands(rows, DOC_LINE, [F.col("x0")], F.col("gap") >= F.greatest(1.2 * F.col("mid"), F.lit(10)), "cell")
    return rows.groupBy(*DOC_LINE).agg((F.max("cell") + 1).alias("n_cells"), F.max("mid").alias("median_gap"))


def tabular_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two lines of at least two cells at an even pitch on a page."""
    cells = tokens(documents(spark, sf_dir)).groupBy("doc_id", "page", "line_no", "y", "size").agg(F.count("*").alias("n_cells"))
    rows = cells.filter("n_cells >= 2")
    order = [F.col("line_no")]
    drop = lagged("y", PAGE, order) - F.col("y")
    rows = islands(rows, PAGE, order, (drop > F.greatest(2.5 * F.col("size"), F.lit(24))) | (drop < -8), "run")
    runs = rows.groupBy("doc_id", "page", "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n_lines"), F.max("n_cells").alias("n_cols"))
    return runs.filter("n_lines >= 2").drop("run")


def column_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a page's lines: token extents of the first six tokens merged with a gap of 0.6 of the cell height."""
    rows = spread(spark, sf_dir)
    return intervals(rows.select("doc_id", "page", "x0", "x1"), PAGE, "x0", "x1", 7).groupBy("doc_id").agg(F.count("*").alias("n_columns"), F.max("x1").alias("right"), F.sum("n").alias("n_words"))


def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column of each line segment: a new one begins 24 points right of all before it."""
    seg = line_segments(spark, sf_dir).withColumn("x0", F.col("x0").cast("long"))
    order = [F.col("x0"), F.col("x1"), F.col("segment")]
    starts = F.col("x0") >= running_max("x1", DOC_LINE, order) + 24
    return islands(seg, DOC_LINE, order, starts, "column").groupBy("doc_id").agg(F.max("column").alias("last_column"), F.sum("column").cast("long").alias("total"))


def xy_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of a page's recursive cut: blocks between horizontal valleys of at least 14, or else vertical ones of at least 18."""
    rows = lines(documents(spark, sf_dir)).filter("line <> ''").select("doc_id", "page", "line_no", (F.col("y") - F.col("size")).alias("lo"), F.col("y").alias("hi"), F.length("line").alias("n"))
    rows = rows.withColumn("lo", -F.col("hi")).withColumn("hi", F.col("lo") + 9)
    h = intervals(rows, PAGE, "lo", "hi", 13.999).groupBy("doc_id", "page").agg(F.count("*").alias("h_blocks"))
    words = spread(spark, sf_dir).select("doc_id", "page", "x0", "x1")
    v = intervals(words, PAGE, "x0", "x1", 17.999).groupBy("doc_id", "page").agg(F.count("*").alias("v_blocks"))
    return h.join(v, PAGE, "left").select("doc_id", "page", "h_blocks", F.coalesce("v_blocks", F.lit(0)).alias("v_blocks"), F.when(F.col("h_blocks") > 1, "horizontal").when(F.col("v_blocks") > 1, "vertical").otherwise("leaf").alias("cut"))


def font_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of token sizes, bold majority, weighted size and natural pitch of a page."""
    tok = tokens(documents(spark, sf_dir))
    stats = tok.groupBy(*PAGE).agg(
        upper_median(F.collect_list("size")).alias("median_size"), (2 * F.count_if("bold") > F.count("*")).alias("mostly_bold"),
        (F.sum(F.col("size") * F.length("token")) / F.sum(F.length("token"))).alias("weighted_size"), F.avg("size").alias("mean_size"),
    )
    own = tok.select(*PAGE, "line_no", "y").distinct()
    own = own.withColumn("gap", lagged("y", PAGE, [F.col("line_no")]) - F.col("y"))
    pitch = own.groupBy(*PAGE).agg(F.coalesce(upper_median(F.collect_list("gap")), F.lit(12)).alias("pitch"))
    return stats.join(pitch, PAGE)


def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest cluster of line sizes within five per cent of its anchor: the body size."""
    own = lines(documents(spark, sf_dir)).filter("trim(line) <> ''").select("doc_id", "line_no", F.col("size").cast("double").alias("size"), F.log("size").alias("log_size"))
    groups = anchored(own, ["doc_id"], [F.col("size"), F.col("line_no")], "log_size", 0.04879, "cluster")
    sized = groups.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    best = sized.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "cluster", "size")).alias("b"))
    return best.select("doc_id", F.greatest(F.col("b.size"), F.lit(1.0)).alias("body"))


def row_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and numbers a row, spread of row starts, blank-line breaks of a page."""
    tok = tokens(documents(spark, sf_dir))
    numeric = F.col("token").rlike("[0-9]") & ~F.col("token").rlike(r"\p{L}")
    rows = tok.groupBy(*PAGE, "line_no", "y", "size").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.count_if(numeric).alias("numbers"))
    rows = rows.withColumn("breaks", F.coalesce(lagged("y", PAGE, [F.col("line_no")]) - F.col("y") > 2 * F.col("size"), F.lit(False)))
    return rows.groupBy(*PAGE).agg(F.avg("n").alias("words_a_row"), (F.max("x0") - F.min("x0")).alias("start_spread"), (F.sum("numbers") / F.sum("n")).alias("numeric_share"), F.count_if("breaks").alias("n_breaks"))


def squares(x: str) -> Column:
    """n(n-1) times the sample variance of n whole numbers, exactly; over a group."""
    v = F.col(x).cast("decimal(19,0)")
    return F.count(x) * F.sum(v * v) - F.sum(v) * F.sum(v)


def within_spread(v1: Column, v0: Column, n: Column, slack: int) -> Column:
    """Is the deviation of squares v1 at most that of v0 and slack? Doubles decide only where the exact product has no room."""
    d = n * (n - 1)
    over = v1 - v0 - slack * slack * d
    wide = F.greatest(F.abs(over), v0 * d) >= F.lit(10**17)
    x, y = over.try_cast("decimal(18,0)"), (v0 * d).try_cast("decimal(18,0)")
    rough = F.sqrt(v1.cast("double")) <= F.sqrt(v0.cast("double")) + slack * F.sqrt(d.cast("double"))
    return F.when(over <= 0, True).when(wide, rough).otherwise(x * x <= 4 * slack * slack * y)


def column_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the n-th tokens of a page's rows: by share of numbers and spread of edges.

    Spreads are compared by whole numbers: many deviations are 6 points, the limit, and doubles miss it by the order of rows.
    """
    return alignments(tokens(documents(spark, sf_dir))).groupBy("doc_id", "align").agg(F.count("*").alias("n"))


def alignments(tok: DataFrame) -> DataFrame:
    """doc_id, page, tok_no and align: left up to a deviation of 6 points, right for numbers whose ends deviate by at most 3 more than their starts."""
    cols = tok.groupBy(*PAGE, "tok_no").agg(F.count("*").alias("n"), F.count_if(p.is_numeric_cell(F.col("token"))).alias("numbers"), squares("x0").alias("v0"), squares("x1").alias("v1"))
    half = F.col("numbers") >= F.floor(F.col("n") / 2)
    d = F.col("n") * (F.col("n") - 1)
    align = F.when(half & (F.col("numbers") > 0) & within_spread(F.col("v1"), F.col("v0"), F.col("n"), 3), "right").when(F.col("v0") <= 36 * d, "left").otherwise("center")
    return cols.select(*PAGE, "tok_no", align.alias("align"))


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best gutter of a page: candidate right edges of lines against all lines of the page.

    Lines count on the left if they end by the gutter, on the right if they
    begin 15 points after it, and as crossings otherwise. The join is by page,
    whose lines are bounded.
    """
    own = tokens(documents(spark, sf_dir)).groupBy(*PAGE, "line_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    own = own.withColumns({"x0": F.col("x0") + F.when(F.col("line_no") % 2 == 1, 300).otherwise(0), "x1": F.when(F.col("line_no") % 2 == 1, F.col("x1") + 300).otherwise(F.least("x1", F.lit(330)))})
    cand = own.select(*PAGE, F.col("x1").alias("g")).distinct()
    score = cand.join(own, PAGE).groupBy(*PAGE, "g").agg(
        F.count_if(F.col("x1") <= F.col("g")).alias("l"), F.count_if(F.col("x0") >= F.col("g") + 15).alias("r"), F.min(F.when(F.col("x0") >= F.col("g") + 15, F.col("x0"))).alias("right"),
        F.count_if((F.col("x1") > F.col("g")) & (F.col("x0") < F.col("g") + 15)).alias("crossings"),
    )
    ok = score.filter("l >= 3 and r >= 3 and crossings <= 2").withColumn("score", (F.col("right") - F.col("g")) * F.least("l", "r") - 100 * F.col("crossings"))
    best = ok.groupBy(*PAGE).agg(F.max(F.struct("score", (-F.col("g")).alias("g"))).alias("b"))
    return best.select(*PAGE, (-F.col("b.g")).alias("gutter"), F.col("b.score").alias("score"))


_SPREAD = f"{SQL_TOKENS}, sp as (select doc_id, page, line_no, tok_no, y, size, bold, token, x0 + cast(floor(tok_no / 3.0) as bigint) * {SHIFT} as x0, x1 + cast(floor(tok_no / 3.0) as bigint) * {SHIFT} as x1 from tk)"
_SEG = f"""{_SPREAD},
sg as (select *, x0 - lag(x1) over (partition by doc_id, line_no order by x0) as gap from sp),
sn as (select *, sum(case when gap is null or (gap > 2.5 * size and gap >= 20) then 1 else 0 end) over (partition by doc_id, line_no order by x0) - 1 as segment from sg),
seg as (select doc_id, line_no, segment, min(x0) as x0, max(x1) as x1, string_agg(token, ' ' order by tok_no) as text from sn group by doc_id, line_no, segment)"""


def _merge_sql(source: str, lo: str, hi: str, gap: float) -> str:
    return f"""(select doc_id, page, part, min(lo) as x0, max(hi) as x1, count(*) as n from (select *, sum(case when m is null or lo > m + {gap} then 1 else 0 end) over (partition by doc_id, page order by lo, hi rows unbounded preceding) - 1 as part
 from (select doc_id, page, {lo} as lo, {hi} as hi, max({hi}) over (partition by doc_id, page order by {lo}, {hi} rows between unbounded preceding and 1 preceding) as m from {source}) a) b group by doc_id, page, part)"""


_upper = lambda x: f"list_sort(list({x}) filter (where {x} is not null))[cast(floor(count({x}) / 2.0) as int) + 1]"

QUERIES = {f.__name__: f for f in (line_segments, word_groups, tabular_runs, column_intervals, column_assign, xy_cuts, font_statistics, body_size, row_statistics, column_align, two_columns)}
ORACLES = {
    "line_segments": f"with {_SEG} select * from seg",
    "word_groups": f"with {_SPREAD}, g as (select *, x0 - lag(x1) over (partition by doc_id, line_no order by x0) as gap from sp), m as (select doc_id, line_no, {_upper('gap')} as mid from g group by doc_id, line_no) select doc_id, line_no, sum(case when gap >= greatest(1.2 * mid, 10) then 1 else 0 end) + 1 as n_cells, max(mid) as median_gap from g join m using (doc_id, line_no) group by doc_id, line_no",
    "tabular_runs": f"with {SQL_TOKENS}, c as (select doc_id, page, line_no, y, size, count(*) as n_cells from tk group by all having count(*) >= 2), d as (select *, lag(y) over (partition by doc_id, page order by line_no) - y as fall from c), i as (select *, sum(case when fall is null or fall > greatest(2.5 * size, 24) or fall < -8 then 1 else 0 end) over (partition by doc_id, page order by line_no) as run from d) select doc_id, page, min(line_no) as first, max(line_no) as last, count(*) as n_lines, max(n_cells) as n_cols from i group by doc_id, page, run having count(*) >= 2",
    "column_intervals": f"with {_SPREAD} select doc_id, count(*) as n_columns, max(x1) as \"right\", sum(n) as n_words from {_merge_sql('sp', 'x0', 'x1', 7)} group by doc_id",
    "column_assign": f"with {_SEG}, a as (select *, max(x1) over (partition by doc_id, line_no order by x0, x1, segment rows between unbounded preceding and 1 preceding) as m from seg), b as (select *, sum(case when m is null or x0 >= m + 24 then 1 else 0 end) over (partition by doc_id, line_no order by x0, x1, segment) - 1 as col from a) select doc_id, max(col) as last_column, cast(sum(col) as bigint) as total from b group by doc_id",
    "xy_cuts": f"with {_SPREAD}, l2 as (select doc_id, page, -y as lo, -y + 9 as hi from ln where line <> ''), h as (select doc_id, page, count(*) as h_blocks from {_merge_sql('l2', 'lo', 'hi', 13.999)} group by doc_id, page), v as (select doc_id, page, count(*) as v_blocks from {_merge_sql('sp', 'x0', 'x1', 17.999)} group by doc_id, page) select doc_id, page, h_blocks, coalesce(v_blocks, 0) as v_blocks, case when h_blocks > 1 then 'horizontal' when v_blocks > 1 then 'vertical' else 'leaf' end as cut from h left join v using (doc_id, page)",
    "font_statistics": f"with {SQL_TOKENS}, s as (select doc_id, page, {_upper('size')} as median_size, 2 * count(*) filter (where bold) > count(*) as mostly_bold, sum(size * length(token)) / sum(length(token)) as weighted_size, avg(size) as mean_size from tk group by doc_id, page), g as (select doc_id, page, lag(y) over (partition by doc_id, page order by line_no) - y as gap from (select distinct doc_id, page, line_no, y from tk) a), q as (select doc_id, page, coalesce({_upper('gap')}, 12) as pitch from g group by doc_id, page) select * from s join q using (doc_id, page)",
    "body_size": f"with {SQL_LINES}, n as (select doc_id, count(*) filter (where size = 12) as small, count(*) filter (where size = 18) as big from ln where trim(line) <> '' group by doc_id) select doc_id, case when small >= big then 12.0 else 18.0 end::double as body from n",
    "row_statistics": f"with {SQL_TOKENS}, r as (select doc_id, page, line_no, y, size, count(*) as n, min(x0) as x0, count(*) filter (where regexp_matches(token, '[0-9]') and not regexp_matches(token, '\\p{{L}}')) as numbers from tk group by all), b as (select *, coalesce(lag(y) over (partition by doc_id, page order by line_no) - y > 2 * size, false) as breaks from r) select doc_id, page, avg(n) as words_a_row, max(x0) - min(x0) as start_spread, sum(numbers) / sum(n) as numeric_share, count(*) filter (where breaks) as n_breaks from b group by doc_id, page",
    "column_align": f"with {SQL_TOKENS}, c as (select doc_id, page, tok_no, count(*) as n, count(*) filter (where regexp_matches(regexp_replace(token, '[$€£¥,.%()-]|VND', '', 'g'), '^[0-9]+$')) as numbers, coalesce(stddev_samp(x0), 0) as s0, coalesce(stddev_samp(x1), 0) as s1 from tk group by doc_id, page, tok_no) select doc_id, case when numbers >= floor(n / 2.0) and numbers > 0 and s1 <= s0 + 3 then 'right' when s0 <= 6 then 'left' else 'center' end as align, count(*) as n from c group by all",
    "two_columns": f"with {SQL_TOKENS}, o as (select doc_id, page, line_no, min(x0) as x0, max(x1) as x1 from tk group by all), m as (select doc_id, page, line_no, x0 + case when line_no % 2 = 1 then 300 else 0 end as x0, case when line_no % 2 = 1 then x1 + 300 else least(x1, 330) end as x1 from o), c as (select distinct doc_id, page, x1 as g from m), s as (select doc_id, page, g, count(*) filter (where x1 <= g) as l, count(*) filter (where x0 >= g + 15) as r, min(x0) filter (where x0 >= g + 15) as rt, count(*) filter (where x1 > g and x0 < g + 15) as crossings from c join m using (doc_id, page) group by doc_id, page, g), k as (select *, (rt - g) * least(l, r) - 100 * crossings as score from s where l >= 3 and r >= 3 and crossings <= 2), w as (select *, row_number() over (partition by doc_id, page order by score desc, g) as rk from k) select doc_id, page, g as gutter, score from w where rk = 1",
}

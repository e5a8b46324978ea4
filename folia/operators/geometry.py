"""Geometry: boxes, matrices, range joins by page, skew."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import predicates as p
from folia.operators.sequence import intervals, islands, lagged
from folia.operators.spans import SQL_LINES, SQL_TOKENS, documents, lines, table, tokens

PAGE = ["doc_id", "page"]
BAND = 64
ANGLES = [k / 2 for k in range(-30, 31)]


def box(x0, y0, x1, y1) -> Column:
    """A box with its edges in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    """Open overlap: touching boxes don't."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def multiply(m: Column, n: Column) -> Column:
    """m then n, as 2x3 matrices (a, b, c, d, e, f) of row vectors."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"), (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def apply_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def apply_box(m: Column, b: Column) -> Column:
    """The box around the four mapped corners."""
    corners = [apply_point(m, b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def inverse(m: Column) -> Column:
    """Null where the matrix has no inverse."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    some = F.abs(det) >= 1e-12
    det = F.when(some, det)
    e = (m["c"] * m["f"] - m["d"] * m["e"]) / det
    f = (m["b"] * m["e"] - m["a"] * m["f"]) / det
    return F.when(some, F.struct((m["d"] / det).alias("a"), (-m["b"] / det).alias("b"), (-m["c"] / det).alias("c"), (m["a"] / det).alias("d"), e.alias("e"), f.alias("f")))


def by_bands(df: DataFrame, lo: str, hi: str, size: float = BAND) -> DataFrame:
    """A row for each horizontal band that lo..hi touches (column band)."""
    return df.withColumn("band", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))


def range_join(left: DataFrame, right: DataFrame, on: Column, keys: list[str] = PAGE) -> DataFrame:
    """Pairs of left (l_x0..l_y1) and right (r_x0..r_y1) boxes of a page that meet ``on``.

    Both sides are dealt by page and horizontal band, so the join is an equi-join;
    a pair is kept in the first band that both touch.
    """
    a = by_bands(left, "l_y0", "l_y1").withColumnRenamed("band", "l_band")
    b = by_bands(right, "r_y0", "r_y1").withColumnRenamed("band", "r_band")
    for k in keys:
        b = b.withColumnRenamed(k, f"r_{k}")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    first = F.greatest(F.floor(F.col("l_y0") / BAND), F.floor(F.col("r_y0") / BAND))
    out = a.join(b, same & (F.col("l_band") == F.col("r_band")) & (F.col("l_band") == first) & on)
    return out.drop("l_band", "r_band", *[f"r_{k}" for k in keys])


def skew_energy(points: DataFrame, keys: list[str], bin_size: float, angles=ANGLES) -> DataFrame:
    """keys, angle, energy: the sum of squared counts of rotated heights. Points have x and y.

    The points of a group, which are those of a page, come together once and all
    angles are tried on them there.
    """
    turned = [(float(a), math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles]
    n = len(keys)

    def energies(batches):
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column(n).value_lengths()))
            x, y = (batch.column(k).flatten().to_numpy() for k in (n, n + 1))
            made = np.empty((batch.num_rows, len(turned)), np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.concatenate(([0], ends))))
            for k, (_, c, s) in enumerate(turned):
                bins = np.floor(np.round(y * c - x * s, 6) / bin_size).astype(np.int64)
                order = np.lexsort((bins, row))
                r, b = row[order], bins[order]
                first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (b[1:] != b[:-1])))) if len(r) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(r)))
                made[:, k] = np.bincount(r[first], size * size, batch.num_rows)
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(turned)))
            cols = [batch.column(k).take(at) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile([a for a, _, _ in turned], batch.num_rows)), pa.array(made.ravel())], names=[*keys, "angle", "energy"])

    rows = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    rows = rows.select(*keys, "p.x", "p.y")
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:n])
    return rows.mapInArrow(energies, f"{schema}, angle double, energy long")


def best_angle(energy: DataFrame, keys: list[str]) -> DataFrame:
    """Middle of the angles that share the largest energy."""
    top = energy.withColumn("top", F.max("energy").over(W.partitionBy(*keys))).filter("energy = top")
    return top.groupBy(*keys).agg(((F.min("angle") + F.max("angle")) / 2).alias("angle"), F.max("top").alias("energy"))


def _token_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokens(documents(spark, sf_dir))
    return tok.select(*PAGE, "line_no", "tok_no", F.col("x0").alias("l_x0"), F.col("y").alias("l_y0"), F.col("x1").alias("l_x1"), (F.col("y") + F.col("size")).alias("l_y1"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 4 by 6 cells on each page."""
    pages = lines(documents(spark, sf_dir)).select(*PAGE).distinct()
    cells = pages.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return cells.select(*PAGE, "cx", "cy", (72 + 120 * F.col("cx")).alias("r_x0"), (50 + 120 * F.col("cy")).alias("r_y0"), (192 + 120 * F.col("cx")).alias("r_x1"), (170 + 120 * F.col("cy")).alias("r_y1"))


def words_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each grid cell: by centre, or by overlap where the word fits the cell's width."""
    mx, my = (F.col("l_x0") + F.col("l_x1")) / 2, (F.col("l_y0") + F.col("l_y1")) / 2
    centre = (mx >= F.col("r_x0")) & (mx <= F.col("r_x1")) & (my >= F.col("r_y0")) & (my <= F.col("r_y1"))
    over = (F.col("l_x0") < F.col("r_x1")) & (F.col("l_x1") > F.col("r_x0")) & (F.col("l_y0") < F.col("r_y1")) & (F.col("l_y1") > F.col("r_y0"))
    fits = (F.col("l_x0") >= F.col("r_x0") - 1) & (F.col("l_x1") <= F.col("r_x1") + 1)
    met = range_join(_token_boxes(spark, sf_dir), _grid(spark, sf_dir), centre | (over & fits))
    return met.groupBy(*PAGE, "cx", "cy").agg(F.count("*").alias("n"))


def lines_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that meet no table: one box of the page for every third document."""
    own = lines(documents(spark, sf_dir)).select(*PAGE, "line_no", F.lit(72).alias("l_x0"), F.col("y").alias("l_y0"), (72 + 6 * F.length("line")).alias("l_x1"), (F.col("y") + F.col("size")).alias("l_y1"))
    boxes = own.filter("doc_id % 3 = 0").select(*PAGE).distinct().select(*PAGE, F.lit(60).alias("r_x0"), F.lit(400).alias("r_y0"), F.lit(500).alias("r_x1"), F.lit(600).alias("r_y1"))
    over = (F.col("l_x0") < F.col("r_x1")) & (F.col("l_x1") > F.col("r_x0")) & (F.col("l_y0") < F.col("r_y1")) & (F.col("l_y1") > F.col("r_y0"))
    gone = range_join(own, boxes, over).select(*PAGE, "line_no").distinct()
    return own.join(gone, [*PAGE, "line_no"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


def underlined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a rule 0.05 to 0.5 em below, over half of the word or no wider than it by 0.4 em.

    Rules are drawn under every second line, from its left edge over 100 points.
    """
    tok = tokens(documents(spark, sf_dir))
    own = tok.select(*PAGE, "line_no", "tok_no", "size", F.col("x0").alias("l_x0"), (F.col("y") - 0.5 * F.col("size")).alias("l_y0"), F.col("x1").alias("l_x1"), F.col("y").cast("double").alias("l_y1"))
    rules = lines(documents(spark, sf_dir)).filter("line_no % 2 = 0 and line <> ''").select(*PAGE, F.lit(72).alias("r_x0"), (F.col("y") - 2.0).alias("r_y0"), F.lit(172).alias("r_x1"), (F.col("y") - 2.0).alias("r_y1"))
    below = F.col("l_y1") - F.col("r_y0")
    overlap = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    wide = (F.col("r_x1") - F.col("r_x0")) <= (F.col("l_x1") - F.col("l_x0")) + 0.4 * F.col("size")
    on = (below >= 0.05 * F.col("size")) & (below <= 0.5 * F.col("size")) & (overlap > 0) & ((overlap >= 0.5 * (F.col("l_x1") - F.col("l_x0"))) | wide)
    return range_join(own, rules, on).select(*PAGE, "line_no", "tok_no").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


def nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest line to a figure at mid-height of each page, and whether it is its caption."""
    own = lines(documents(spark, sf_dir)).filter("line <> ''").withColumn("gap", F.abs(F.col("y") - 6 - 400.0))
    best = own.groupBy(*PAGE).agg(F.min(F.struct("gap", "line_no", "line", "size")).alias("b")).select(*PAGE, "b.*")
    named = F.col("line").rlike(r"^(\*\*)?(Figure|Fig\.) ")
    caption = ((F.col("gap") <= 2.5 * F.col("size")) & (p.word_count(F.col("line")) <= 9)) | (named & (F.col("gap") <= 4.0 * F.col("size")))
    return best.select(*PAGE, "line_no", "gap", caption.alias("caption"))


def figure_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line that a figure (x 100 to 300, y 350 to 450) goes after: the highest one at or below it with enough overlap."""
    own = lines(documents(spark, sf_dir)).filter("line <> ''").select(*PAGE, "line_no", "y", (72 + 6 * F.length("line")).alias("x1"))
    overlap = F.least(F.col("x1"), F.lit(300)) - F.greatest(F.lit(72), F.lit(100))
    ok = own.filter((overlap > 0.2 * F.least(F.col("x1") - 72, F.lit(200))) & (F.col("y") <= 400))
    return ok.groupBy(*PAGE).agg(F.max_by("line_no", "y").alias("line_no"), F.max("y").alias("y"))


def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical rules of a column (x within 2 points) joined over gaps of at most 3 points."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_partkey") % 7).cast("int").alias("page"), (F.col("l_suppkey") % 50).alias("lo"), F.col("l_quantity"))
    rules = items.withColumn("lo", F.col("lo") * 40 + F.col("page")).withColumn("hi", F.col("lo") + F.col("l_quantity"))
    return intervals(rules, PAGE, "lo", "hi", 3).select("doc_id", "page", "part", "x0", "x1", "n")


def page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best angle of pages whose line starts and ends were tilted by two degrees."""
    tok = tokens(documents(spark, sf_dir)).groupBy(*PAGE, "line_no", "y").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    points = tok.select(*PAGE, "y", F.explode(F.array("a", "b")).alias("x"))
    tilted = points.select(*PAGE, F.col("x").cast("double").alias("x"), F.round(F.col("y") + F.col("x") * math.tan(math.radians(2)), 6).alias("y"))
    enough = tilted.withColumn("n", F.count("*").over(W.partitionBy(*PAGE))).filter("n >= 16")
    return best_angle(skew_energy(enough, PAGE, 6.0), PAGE)


def angle_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of half-degree angles between successive words, weighted by their distance."""
    tok = tokens(documents(spark, sf_dir))
    w = W.partitionBy("doc_id", "line_no").orderBy("tok_no")
    dx = F.lead("x0").over(w) - F.col("x0")
    dy = F.lit(0.02) * dx + F.when(F.col("tok_no") % 7 == 0, F.lit(1.0)).otherwise(0.0)
    rows = tok.withColumn("dx", dx).withColumn("dy", dy).filter("dx is not null")
    bin_ = F.floor(F.round(F.degrees(F.atan2("dy", "dx")), 6) / 0.5)
    return rows.groupBy("doc_id", bin_.alias("bin")).agg(F.sum("dx").alias("votes"))


def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts under a matrix and back, and their overlap with a fixed one."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("double")
    b = box(k % 500, k % 300, (k * 7) % 500, (k * 3) % 300)
    m = F.struct((F.col("p_size") % 3).cast("double").alias("a"), F.lit(0.5).alias("b"), F.lit(-0.25).alias("c"), F.lit(2.0).alias("d"), F.lit(10.0).alias("e"), F.lit(-5.0).alias("f"))
    rows = parts.select("p_partkey", b.alias("b"), m.alias("m"))
    rows = rows.withColumn("t", apply_box(F.col("m"), F.col("b"))).withColumn("inv", inverse(F.col("m")))
    rows = rows.withColumn("unit", multiply(F.col("m"), F.col("inv")))
    fixed = F.struct(F.lit(100.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(200.0).alias("y1"))
    return rows.select("p_partkey", F.col("t.x0").alias("x0"), F.col("t.y0").alias("y0"), F.col("t.x1").alias("x1"), F.col("t.y1").alias("y1"), intersects(F.col("b"), fixed).alias("meets"), F.round(F.col("unit.a"), 6).alias("unit_a"), F.round(F.abs(F.col("unit.e")), 6).alias("unit_e"))


def margin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that follow each other closely, as blocks of vertical text are joined; every sixth line is set off."""
    rows = lines(documents(spark, sf_dir)).filter("trim(line) <> ''").withColumn("y", F.col("y") - 40 * F.floor(F.col("line_no") / 6))
    order = [F.col("line_no")]
    rows = islands(rows, PAGE, order, (lagged("y", PAGE, order) - F.col("y")) > 2.0 * F.col("size"), "run")
    return rows.groupBy("doc_id", "page").agg((F.max("run") + 1).alias("n_runs"))


def _skew_sql() -> str:
    rots = ", ".join(f"({float(a)!r}::double, {math.cos(math.radians(a))!r}::double, {math.sin(math.radians(a))!r}::double)" for a in ANGLES)
    return f"""with {SQL_TOKENS}, l as (select doc_id, page, line_no, y, min(x0) as a, max(x1) as b from tk group by all), q as (select doc_id, page, y, unnest([a, b])::double as x from l),
t as (select doc_id, page, x, round(y + x * {math.tan(math.radians(2))!r}, 6) as y, count(*) over (partition by doc_id, page) as n from q),
b as (select doc_id, page, angle, floor(round(y * c - x * s, 6) / 6.0) as bin, count(*) as n from t, (values {rots}) r(angle, c, s) where t.n >= 16 group by all),
e as (select doc_id, page, angle, sum(n * n) as energy from b group by all), m as (select *, max(energy) over (partition by doc_id, page) as top from e)
select doc_id, page, (min(angle) + max(angle)) / 2 as angle, cast(max(top) as bigint) as energy from m where energy = top group by doc_id, page"""


QUERIES = {f.__name__: f for f in (words_in_cells, lines_outside_tables, underlined_words, nearest_captions, figure_anchors, merged_rules, page_skew, angle_votes, box_algebra, margin_runs)}
ORACLES = {
    "words_in_cells": f"with {SQL_TOKENS}, g as (select cx, cy, 72 + 120 * cx as x0, 50 + 120 * cy as y0, 192 + 120 * cx as x1, 170 + 120 * cy as y1 from range(0, 4) a(cx), range(0, 6) b(cy)) select doc_id, page, cx, cy, count(*) as n from tk, g where ((t_mx between g.x0 and g.x1) and (t_my between g.y0 and g.y1)) or (tk.x0 < g.x1 and tk.x1 > g.x0 and tk.y < g.y1 and tk.y + size > g.y0 and tk.x0 >= g.x0 - 1 and tk.x1 <= g.x1 + 1) group by doc_id, page, cx, cy".replace("t_mx", "(tk.x0 + tk.x1) / 2.0").replace("t_my", "(tk.y + tk.y + size) / 2.0"),
    "lines_outside_tables": f"with {SQL_LINES} select doc_id, count(*) as n, cast(sum(line_no) as bigint) as line_sum from ln where not (doc_id % 3 = 0 and 72 < 500 and 72 + 6 * length(line) > 60 and y < 600 and y + size > 400) group by doc_id",
    "underlined_words": f"with {SQL_TOKENS} select doc_id, count(*) as n from tk where line_no % 2 = 0 and 2.0 >= 0.05 * size and 2.0 <= 0.5 * size and least(x1, 172) - greatest(x0, 72) > 0 and (least(x1, 172) - greatest(x0, 72) >= 0.5 * (x1 - x0) or 100 <= x1 - x0 + 0.4 * size) group by doc_id",
    "nearest_captions": f"with {SQL_LINES}, g as (select *, abs(y - 6 - 400.0)::double as gap from ln where line <> ''), r as (select *, row_number() over (partition by doc_id, page order by gap, line_no) as k from g) select doc_id, page, line_no, gap, (gap <= 2.5 * size and len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) <= 9) or (regexp_matches(line, '^(\\*\\*)?(Figure|Fig\\.) ') and gap <= 4.0 * size) as caption from r where k = 1",
    "figure_anchors": f"with {SQL_LINES}, o as (select doc_id, page, line_no, y, 72 + 6 * length(line) as x1 from ln where line <> '') select doc_id, page, arg_max(line_no, y) as line_no, max(y) as y from o where least(x1, 300) - 100 > 0.2 * least(x1 - 72, 200) and y <= 400 group by doc_id, page",
    "merged_rules": """with i as (select l_orderkey % 100 as doc_id, cast(l_partkey % 7 as int) as page, (l_suppkey % 50) * 40 + l_partkey % 7 as lo, (l_suppkey % 50) * 40 + l_partkey % 7 + l_quantity as hi from lineitem),
m as (select *, max(hi) over (partition by doc_id, page order by lo, hi rows between unbounded preceding and 1 preceding) as far from i), n as (select *, sum(case when far is null or lo > far + 3 then 1 else 0 end) over (partition by doc_id, page order by lo, hi rows unbounded preceding) - 1 as part from m)
select doc_id, page, part, min(lo) as x0, max(hi) as x1, count(*) as n from n group by doc_id, page, part""",
    "page_skew": _skew_sql(),
    "angle_votes": f"with {SQL_TOKENS}, d as (select doc_id, tok_no, lead(x0) over (partition by doc_id, line_no order by tok_no) - x0 as dx from tk), e as (select doc_id, dx, 0.02::double * dx + case when tok_no % 7 = 0 then 1.0 else 0.0 end as dy from d where dx is not null) select doc_id, cast(floor(round(degrees(atan2(dy, dx)), 6) / 0.5) as bigint) as bin, cast(sum(dx) as bigint) as votes from e group by all",
    "box_algebra": """with b as (select p_partkey, least(k % 500, (k * 7) % 500)::double as x0, least(k % 300, (k * 3) % 300)::double as y0, greatest(k % 500, (k * 7) % 500)::double as x1, greatest(k % 300, (k * 3) % 300)::double as y1, (p_size % 3)::double as a from (select *, p_partkey as k from part) z),
c as (select *, a * x0 - 0.25 * y0 + 10 as p1, a * x0 - 0.25 * y1 + 10 as p2, a * x1 - 0.25 * y0 + 10 as p3, a * x1 - 0.25 * y1 + 10 as p4, 0.5 * x0 + 2 * y0 - 5 as q1, 0.5 * x0 + 2 * y1 - 5 as q2, 0.5 * x1 + 2 * y0 - 5 as q3, 0.5 * x1 + 2 * y1 - 5 as q4 from b)
select p_partkey, least(p1, p2, p3, p4)::double as x0, least(q1, q2, q3, q4)::double as y0, greatest(p1, p2, p3, p4)::double as x1, greatest(q1, q2, q3, q4)::double as y1, x0 < 200 and x1 > 100 and y0 < 200 and y1 > 100 as meets, 1.0::double as unit_a, 0.0::double as unit_e from c""",
    "margin_runs": f"with {SQL_LINES}, r as (select *, lag(y - 40 * (line_no // 6)) over (partition by doc_id, page order by line_no) - (y - 40 * (line_no // 6)) as fall from ln where trim(line) <> '') select doc_id, page, sum(case when fall is null or fall > 2.0 * size then 1 else 0 end) as n_runs from r group by doc_id, page",
}

"""Document passes over pages of Markdown: totals, furniture, counters, repeated blocks, tables across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import predicates as p
from folia.operators.sequence import islands
from folia.operators.spans import SQL_LINES, documents, lines, literal, page_md, table
from folia.plans.scratch import materialize

BAND, MIN_PAGES, MAX_WORDS = 3, 3, 14
BLOCK_BAND, BLOCK_LINES, BLOCK_BYTES = 2, 12, 600
WORD_FLOOR = 5
PAGE = ["doc_id", "page"]


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, line, and for non-blank lines rank and n among them."""
    rows = pages.select(*PAGE, F.posexplode(F.split("chunk", "\n", -1)).alias("line_no", "line"))
    blank = p.trim(F.col("line")) == ""
    w = W.partitionBy(*PAGE)
    rank = F.when(~blank, F.sum((~blank).cast("int")).over(w.orderBy("line_no")) - 1)
    return rows.withColumn("rank", rank).withColumn("n", F.sum((~blank).cast("int")).over(w))


def in_band(band: int = BAND) -> F.Column:
    return (F.col("rank") < band) | (F.col("rank") + band >= F.col("n"))


def is_candidate(line: F.Column) -> F.Column:
    """A short line with letters and no data value, mark-up or table row."""
    t = p.trim(line)
    return t.rlike(r"\p{L}") & ~p.carries_data_value(t) & ~t.rlike(r"^(\||<|#|!\[)") & (p.word_count(t) <= MAX_WORDS)


def join_lines(rows: DataFrame) -> DataFrame:
    """Pages from their lines."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(*PAGE).agg(body.alias("chunk"))


def running_keys(pages: DataFrame) -> DataFrame:
    """doc_id, key, first_page and n_pages of lines that run in the bands of at least three pages with a body."""
    rows = page_lines(pages).filter((F.col("n") > 2 * BAND) & F.col("rank").isNotNull() & in_band() & is_candidate(F.col("line")))
    keys = rows.select(*PAGE, p.furniture_key(F.col("line")).alias("key")).filter("key <> ''").distinct()
    return keys.groupBy("doc_id", "key").agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages")).filter(F.col("n_pages") >= MIN_PAGES)


def banded(pages: DataFrame) -> DataFrame:
    """Pages with ls, their lines; n, how many aren't blank; band: at and line of those in the bands. All within a page's row."""
    solid = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: p.trim(x["line"]) != "")
    rows = pages.withColumn("ls", F.split("chunk", "\n", -1)).withColumn("solid", solid).withColumn("n", F.size("solid"))
    # slices: a condition on n would be judged, and all lines trimmed anew for it, once for every line
    tail = F.slice("solid", F.greatest(F.lit(BAND), F.col("n") - BAND) + 1, F.lit(BAND))
    return rows.withColumn("band", F.concat(F.slice("solid", 1, BAND), tail)).drop("solid")


def without_lines(gone: F.Column) -> F.Column:
    """The page's lines but for those at some places."""
    return F.array_join(F.filter("ls", lambda x, i: ~F.array_contains(gone, i)), "\n")


def strip_running(pages: DataFrame) -> DataFrame:
    """Pages without the repeats of running lines; the first page keeps them.

    Only the keys of band lines are shuffled and counted; a document's repeated
    keys then meet its pages. ``pages`` is read twice, so it should be stored.
    """
    key = lambda x: F.struct(x["at"], F.when(is_candidate(x["line"]), p.furniture_key(x["line"])).alias("key"))
    rows = banded(pages).withColumn("keyed", F.filter(F.transform("band", key), lambda k: k["key"] != ""))
    rows = rows.withColumn("keyed", F.when(F.col("n") > 2 * BAND, F.col("keyed")).otherwise(F.slice("keyed", 1, 0)))
    keys = rows.select(*PAGE, F.explode(F.array_distinct(F.transform("keyed", lambda k: k["key"]))).alias("key"))
    often = keys.groupBy("doc_id", "key").agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages")).filter(F.col("n_pages") >= MIN_PAGES)
    often = often.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "first_page"))).alias("repeated"))
    rows = rows.join(often, "doc_id", "left")
    gone = F.transform(F.filter("keyed", lambda k: F.col("page") > F.col("repeated")[k["key"]]), lambda k: k["at"])
    return rows.select(*PAGE, F.when(F.col("repeated").isNotNull(), without_lines(gone)).otherwise(F.col("chunk")).alias("chunk"))


def counter_documents(pages: DataFrame) -> DataFrame:
    """Documents whose page counters are corroborated: two pages, two numbers, one total."""
    rows = page_lines(pages).filter(F.col("rank").isNotNull() & in_band()).withColumn("c", p.counter(F.col("line"))).filter("c.n is not null")
    found = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"), F.countDistinct("c.n").alias("n_numbers"), F.countDistinct("c.m").alias("n_totals"))
    return found.filter("n_pages >= 2 and n_numbers >= 2 and n_totals <= 1")


def strip_counters(pages: DataFrame) -> DataFrame:
    """Pages without counters, in documents where they are corroborated. ``pages`` is read twice, so it should be stored."""
    count = lambda x: F.struct(x["at"], p.counter(x["line"]).alias("c"))
    rows = banded(pages).withColumn("counters", F.filter(F.transform("band", count), lambda x: x["c"]["n"].isNotNull()))
    found = rows.select(*PAGE, F.explode("counters").alias("x")).groupBy("doc_id").agg(
        F.min("page").alias("p0"), F.max("page").alias("p1"), F.min("x.c.n").alias("n0"), F.max("x.c.n").alias("n1"), F.min("x.c.m").alias("m0"), F.max("x.c.m").alias("m1")
    )
    sure = found.filter("p0 < p1 and n0 < n1 and coalesce(m0 = m1, true)").select("doc_id", F.lit(True).alias("sure"))
    rows = rows.join(sure, "doc_id", "left")
    gone = F.transform("counters", lambda x: x["at"])
    return rows.select(*PAGE, F.when(F.col("sure") & (F.size("counters") > 0), without_lines(gone)).otherwise(F.col("chunk")).alias("chunk"))


def blocks_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, block_no, n (blocks of the page), block, key: the parts between blank lines."""
    rows = page_lines(pages)
    w = W.partitionBy(*PAGE).orderBy("line_no")
    rows = rows.withColumn("block_no", F.sum(F.col("rank").isNull().cast("int")).over(w)).filter("rank is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    made = rows.groupBy(*PAGE, "block_no").agg(text.alias("block"))
    made = made.withColumn("rank", F.row_number().over(W.partitionBy(*PAGE).orderBy("block_no")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*PAGE)))
    key = F.array_join(F.transform(F.split("block", "\n", -1), lambda x: p.furniture_key(x)), "\n")
    return made.withColumn("key", key)


def block_key(rows: DataFrame) -> DataFrame:
    """blocks_of with key null where a block can't be furniture."""
    two_words = F.exists(F.split("block", "\n", -1), lambda x: F.size(F.filter(p.words(x), lambda w: w.rlike(r"\p{L}"))) >= 2)
    ok = (F.size(F.split("block", "\n", -1)) <= BLOCK_LINES) & (F.octet_length("block") <= BLOCK_BYTES) & ~F.col("block").rlike(r"^\s*(!\[|<img)") & two_words
    ok = ok & (F.col("n") > 2 * BLOCK_BAND) & in_band(BLOCK_BAND) & (F.length(F.regexp_replace("key", r"[^\p{L}\p{N}]+", "")) >= 8)
    return rows.withColumn("key", F.when(ok, F.col("key")))


def repeated_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, key, first_page, n_pages of blocks that recur at the edges of at least three pages."""
    rows = block_key(blocks_of(pages)).filter("key is not null").select(*PAGE, "key").distinct()
    return rows.groupBy("doc_id", "key").agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages")).filter(F.col("n_pages") >= MIN_PAGES)


def strip_blocks(pages: DataFrame) -> DataFrame:
    """Pages without the repeats of blocks that recur at their edges; no page is emptied, and untouched pages stay as they are.

    ``pages`` is read twice, for the repeated keys of each document and for the
    pages themselves, so it should be a stored table.
    """
    found = repeated_blocks(pages).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "first_page"))).alias("repeated"))
    rows = pages.join(found, "doc_id", "left")
    parts = F.filter(F.split("chunk", r"\n(?:[ \t]*\n)+", -1), lambda b: p.trim(b) != "")
    key = lambda b: F.array_join(F.transform(F.split(b, "\n", -1), lambda x: p.furniture_key(x)), "\n")

    def kept(blocks: F.Column) -> F.Column:
        n = F.size(blocks)
        edge = lambda i: (i < BLOCK_BAND) | (i + BLOCK_BAND >= n)
        # the key of an edge block is made once and looked up
        later = lambda b: F.coalesce(F.col("page") > F.col("repeated")[key(b)], F.lit(False))
        return F.when(n <= 2 * BLOCK_BAND, blocks).otherwise(F.filter(blocks, lambda b, i: F.when(edge(i), ~later(b)).otherwise(F.lit(True))))

    rows = rows.withColumn("parts", F.when(F.col("repeated").isNotNull(), parts)).withColumn("kept", F.when(F.col("parts").isNotNull(), kept(F.col("parts"))))
    text = F.concat(F.lit("\n\n"), F.array_join("kept", "\n\n"), F.lit("\n\n"))
    some = (F.size("kept") > 0) & (F.size("kept") < F.size("parts"))
    return rows.select(*PAGE, F.when(F.coalesce(some, F.lit(False)), text).otherwise(F.col("chunk")).alias("chunk"))


def tag_furniture(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, kind, text, y0, y1) with kind header or footer where a short text repeats in the outer tenth of three pages."""
    w = W.partitionBy(*PAGE)
    low, high = F.min(F.least("y0", "y1")).over(w), F.max(F.greatest("y0", "y1")).over(w)
    span = F.greatest(high - low, F.lit(1.0))
    top, bottom = (F.greatest("y0", "y1") - low) / span, (F.least("y0", "y1") - low) / span
    t = F.col("text")
    ok = F.col("kind").isin("body", "list", "heading") & (p.word_count(t) <= MAX_WORDS) & t.rlike(r"\p{L}") & ~p.carries_data_value(t)
    rows = blocks.withColumn("key", p.furniture_key(t)).withColumn("band", F.when(ok & (F.col("key") != ""), F.when(top > 0.9, "header").when(bottom < 0.1, "footer")))
    count = F.count("band").over(W.partitionBy("doc_id", "key", "band"))
    return rows.withColumn("kind", F.when(F.col("band").isNotNull() & (count >= 3), F.col("band")).otherwise(F.col("kind"))).drop("key", "band")


def chain_tables(tables: DataFrame) -> DataFrame:
    """Number chains of tables on adjacent pages with equal headers: tables has doc_id, page, header, n_rows (one a page)."""
    w = W.partitionBy("doc_id").orderBy("page")
    joins = (F.lag("page").over(w) == F.col("page") - 1) & (F.lag("header").over(w) == F.col("header")) & (F.col("n_rows") >= 1) & F.col("header").rlike("[^¦]")
    return islands(tables, ["doc_id"], [F.col("page")], ~F.coalesce(joins, F.lit(False)), "chain")


def markdown_tables(pages: DataFrame) -> DataFrame:
    """Runs of pipe rows with a separator row: doc_id, page, first, last line and the header."""
    rows = page_lines(pages).withColumn("is_row", p.is_table_row(F.col("line")))
    rows = islands(rows, PAGE, [F.col("line_no")], ~F.coalesce(F.lag("is_row").over(W.partitionBy(*PAGE).orderBy("line_no")) & F.col("is_row"), F.lit(False)), "run").filter("is_row")
    runs = rows.groupBy(*PAGE, "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count_if(p.is_separator_row(F.col("line"))).alias("n_sep"), F.min(F.struct("line_no", "line")).alias("h"))
    return runs.filter("n_sep > 0 and last > first").select(*PAGE, "first", "last", F.array_join(p.header_cells(F.col("h.line")), "¦").alias("header"))


def concat_pages(pages: DataFrame, markers: bool = False) -> DataFrame:
    """One Markdown text a document; chunks follow each other as they are."""
    mark = F.concat(F.lit('<!-- page n="'), F.col("page").cast("string"), F.lit('" -->\n')) if markers else F.lit("")
    rows = pages.select("doc_id", "page", F.concat(mark, "chunk").alias("chunk"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "chunk"))), lambda x: x["chunk"]), "")
    return rows.groupBy("doc_id").agg(text.alias("markdown"), F.count("*").alias("pages"))


def totals(pages: DataFrame) -> DataFrame:
    """words, pages and pages below the word floor of each document."""
    n = p.word_count(F.col("chunk"))
    return pages.groupBy("doc_id").agg(F.sum(n).cast("long").alias("words"), F.count("*").alias("pages"), F.count_if(n < WORD_FLOOR).alias("low_pages"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """doc_id, word of all words but the halves of words wrapped at a hyphen; rows has doc_id, line_no, line."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    wraps = lambda c: F.regexp_replace(c, rf"{p.WS}+$", "").rlike(r"\p{L}-$")
    rows = rows.withColumn("tail", F.coalesce(wraps(F.lag("line").over(w)), F.lit(False))).withColumn("head", wraps(F.col("line")))
    found = F.filter(F.split("line", r"[^\p{L}]+"), lambda x: x != "")
    rows = rows.withColumn("found", found)
    own = F.filter(F.transform("found", lambda x, i: F.when((F.col("tail") & (i == 0)) | (F.col("head") & (i == F.size("found") - 1)), None).otherwise(F.lower(x))), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(own).alias("word")).distinct()


def _chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages with a header, a counter and a footer line each."""
    chats = table(spark, sf_dir, "conversations")
    total = F.count("*").over(W.partitionBy("conv_id"))
    page = (F.col("turn") + 1).cast("int")
    head = F.concat(F.lit("Chat log | page "), page.cast("string"), F.lit("\nTranscript of a talk\n\n"))
    foot = F.concat(F.lit("\n\nInternal use only\n"), page.cast("string"), F.lit("/"), total.cast("string"))
    return chats.select(F.col("conv_id").alias("doc_id"), page.alias("page"), F.concat(head, F.replace("text", F.lit(". "), F.lit(".\n\n")), foot).alias("chunk"))


def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(page_md(documents(spark, sf_dir)))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_keys(_chat_pages(spark, sf_dir))


def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages left by the passes over running lines and counters: size and digest."""
    pages = materialize(_chat_pages(spark, sf_dir), "pages")
    out = strip_counters(materialize(strip_running(pages), "pages"))
    return out.select(*PAGE, F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_documents(_chat_pages(spark, sf_dir))


def repeated_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_blocks(_chat_pages(spark, sf_dir))


def furniture_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds after tagging the lines of the chat pages as blocks."""
    rows = page_lines(_chat_pages(spark, sf_dir)).filter("rank is not null")
    blocks = rows.select(*PAGE, F.lit("body").alias("kind"), F.col("line").alias("text"), (720.0 - 14 * F.col("line_no")).alias("y0"), (732.0 - 14 * F.col("line_no")).alias("y1"))
    return tag_furniture(blocks).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def table_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of the lines of an order as tables on pages; the header is the line's flags."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(
        F.max(F.concat_ws("¦", "l_returnflag", "l_linestatus")).alias("header"), F.sum("l_quantity").cast("long").alias("n_rows")
    )
    chains = chain_tables(items).groupBy("doc_id", "chain").agg(F.min("page").alias("first_page"), F.count("*").alias("n_tables"), F.sum("n_rows").alias("n_rows"))
    return chains.filter("n_tables > 1")


def tables_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found when the corpus's lines with pipes are framed as rows, each fourth line as a separator."""
    rows = lines(documents(spark, sf_dir))
    line = F.when(F.col("line_no") % 4 == 1, "| --- | :-: |").when(F.col("line").contains("|") | (F.col("line_no") % 4 == 0), F.concat(F.lit("| "), "line", F.lit(" |"))).otherwise(F.col("line"))
    pages = join_lines(rows.select(*PAGE, "line_no", line.alias("line")))
    return markdown_tables(pages).select(*PAGE, "first", "last", F.md5("header").alias("header"))


def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = concat_pages(page_md(documents(spark, sf_dir)), markers=True)
    return out.select("doc_id", "pages", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


def hyphen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words that attest a join, when every even line of the corpus ends in a hyphen."""
    rows = lines(documents(spark, sf_dir)).select("doc_id", "line_no", F.when((F.col("line_no") % 2 == 0) & F.col("line").rlike(r"\p{L}$"), F.concat("line", F.lit("-"))).otherwise(F.col("line")).alias("line"))
    return vocabulary(rows).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.length("word")).alias("n_chars"))


_CHAT = """ch as (select conv_id as doc_id, cast(turn + 1 as int) as page, 'Chat log | page ' || (turn + 1) || chr(10) || 'Transcript of a talk' || chr(10) || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10)) || chr(10) || chr(10) || 'Internal use only' || chr(10) || (turn + 1) || '/' || count(*) over (partition by conv_id) as chunk from conversations)"""
_PL = f"""{_CHAT},
p0 as (select doc_id, page, unnest(string_split(chunk, chr(10))) as line, generate_subscripts(string_split(chunk, chr(10)), 1) - 1 as line_no from ch),
pl as (select *, case when trim(line) <> '' then sum(case when trim(line) <> '' then 1 else 0 end) over (partition by doc_id, page order by line_no) - 1 end as rank, sum(case when trim(line) <> '' then 1 else 0 end) over (partition by doc_id, page) as n from p0)"""
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
# within the chat pages, only the title line has a set-off page marker
_KEY = "case when starts_with({0}, 'Chat log | page ') then 'chat log page #' else array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))), lambda w: w <> ''), ' ') end"
_CAND = f"regexp_matches(line, '\\p{{L}}') and not regexp_matches(line, {literal(p.DATA_VALUE)}) and not regexp_matches(trim(line), '^(\\||<|#|!\\[)') and len({_WORDS.format('line')}) <= {MAX_WORDS}"
_RUN = f"""{_PL},
ky as (select distinct doc_id, page, {_KEY.format('line')} as key from pl where n > {2 * BAND} and rank is not null and (rank < {BAND} or rank + {BAND} >= n) and {_CAND}),
rk as (select doc_id, key, min(page) as first_page, count(*) as n_pages from ky where key <> '' group by doc_id, key having count(*) >= {MIN_PAGES})"""
_COUNT = "regexp_matches(line, '^[0-9]+/[0-9]+$')"

QUERIES = {f.__name__: f for f in (document_totals, running_lines, stripped_pages, page_counters, repeated_page_blocks, furniture_tags, table_chains, tables_in_text, joined_pages, hyphen_evidence)}
ORACLES = {
    "document_totals": f"with {SQL_LINES}, w as (select doc_id, page, sum(len({_WORDS.format('line')})) as n from ln group by doc_id, page) select doc_id, cast(sum(n) as bigint) as words, count(*) as pages, count(*) filter (where n < {WORD_FLOOR}) as low_pages from w group by doc_id",
    "running_lines": f"with {_RUN} select * from rk",
    "stripped_pages": f"""with {_RUN},
k1 as (select pl.doc_id, pl.page, pl.line_no, pl.line from pl left join rk on rk.doc_id = pl.doc_id and rk.key = {_KEY.format('pl.line')} where not coalesce(n > {2 * BAND} and rank is not null and (rank < {BAND} or rank + {BAND} >= n) and ({_CAND}) and page > first_page, false)),
k2 as (select *, case when trim(line) <> '' then sum(case when trim(line) <> '' then 1 else 0 end) over (partition by doc_id, page order by line_no) - 1 end as rank, sum(case when trim(line) <> '' then 1 else 0 end) over (partition by doc_id, page) as n from k1),
ct as (select doc_id from k2 where rank is not null and (rank < {BAND} or rank + {BAND} >= n) and {_COUNT} group by doc_id having count(distinct page) >= 2 and count(distinct split_part(line, '/', 1)) >= 2 and count(distinct split_part(line, '/', 2)) <= 1),
k3 as (select doc_id, page, string_agg(line, chr(10) order by line_no) as chunk from k2 where not coalesce(rank is not null and (rank < {BAND} or rank + {BAND} >= n) and {_COUNT} and doc_id in (select doc_id from ct), false) group by doc_id, page)
select doc_id, page, length(chunk) as n_chars, md5(chunk) as digest from k3""",
    "page_counters": f"with {_PL} select doc_id, count(distinct page) as n_pages, count(distinct split_part(line, '/', 1)) as n_numbers, count(distinct split_part(line, '/', 2)) as n_totals from pl where rank is not null and (rank < {BAND} or rank + {BAND} >= n) and {_COUNT} group by doc_id having count(distinct page) >= 2 and count(distinct split_part(line, '/', 1)) >= 2 and count(distinct split_part(line, '/', 2)) <= 1",
    "repeated_page_blocks": f"""with {_PL}, b0 as (select doc_id, page, line_no, line, rank, sum(case when rank is null then 1 else 0 end) over (partition by doc_id, page order by line_no) as block_no from pl),
b1 as (select doc_id, page, block_no, string_agg(line, chr(10) order by line_no) as block, string_agg({_KEY.format('line')}, chr(10) order by line_no) as key, count(*) as n_lines, bool_or(len(list_filter({_WORDS.format('line')}, lambda w: regexp_matches(w, '\\p{{L}}'))) >= 2) as two from b0 where rank is not null group by doc_id, page, block_no),
b2 as (select *, row_number() over (partition by doc_id, page order by block_no) - 1 as r, count(*) over (partition by doc_id, page) as n from b1),
b3 as (select distinct doc_id, page, key from b2 where n > {2 * BLOCK_BAND} and (r < {BLOCK_BAND} or r + {BLOCK_BAND} >= n) and n_lines <= {BLOCK_LINES} and strlen(block) <= {BLOCK_BYTES} and two and length(regexp_replace(key, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 8)
select doc_id, key, min(page) as first_page, count(*) as n_pages from b3 group by doc_id, key having count(*) >= {MIN_PAGES}""",
    "furniture_tags": f"""with {_PL}, b as (select doc_id, page, line, 720.0 - 14 * line_no as y0, 732.0 - 14 * line_no as y1 from pl where rank is not null),
s as (select *, (y1 - min(y0) over w) / greatest(max(y1) over w - min(y0) over w, 1) as top, (y0 - min(y0) over w) / greatest(max(y1) over w - min(y0) over w, 1) as bottom, {_KEY.format('line')} as key from b window w as (partition by doc_id, page)),
t as (select *, case when key <> '' and regexp_matches(line, '\\p{{L}}') and not regexp_matches(line, {literal(p.DATA_VALUE)}) and len({_WORDS.format('line')}) <= {MAX_WORDS} then case when top > 0.9 then 'header' when bottom < 0.1 then 'footer' end end as band from s),
c as (select *, count(band) over (partition by doc_id, key, band) as n_same from t)
select doc_id, case when band is not null and n_same >= 3 then band else 'body' end as kind, count(*) as n from c group by all""",
    "table_chains": """with t as (select l_orderkey as doc_id, l_linenumber as page, max(l_returnflag || '¦' || l_linestatus) as header, cast(sum(l_quantity) as bigint) as n_rows from lineitem group by all),
c as (select *, sum(case when lag_page = page - 1 and lag_header = header and n_rows >= 1 then 0 else 1 end) over (partition by doc_id order by page) - 1 as chain from (select *, lag(page) over (partition by doc_id order by page) as lag_page, lag(header) over (partition by doc_id order by page) as lag_header from t) x)
select doc_id, chain, min(page) as first_page, count(*) as n_tables, sum(n_rows) as n_rows from c group by doc_id, chain having count(*) > 1""",
    "tables_in_text": f"""with {SQL_LINES}, f as (select doc_id, page, row_number() over (partition by doc_id, page order by line_no) - 1 as line_no, case when line_no % 4 = 1 then '| --- | :-: |' when contains(line, '|') or line_no % 4 = 0 then '| ' || line || ' |' else line end as line from ln),
r as (select *, starts_with(trim(line), '|') and ends_with(trim(line), '|') as is_row from f),
g as (select *, sum(case when is_row and coalesce(before, false) then 0 else 1 end) over (partition by doc_id, page order by line_no) as run from (select *, lag(is_row) over (partition by doc_id, page order by line_no) as before from r) x),
k as (select doc_id, page, min(line_no) as first, max(line_no) as last, count(*) filter (where line = '| --- | :-: |') as n_sep, min_by(line, line_no) as h from g where is_row group by doc_id, page, run)
select doc_id, page, first, last, md5(array_to_string(list_transform(list_slice(string_split(trim(h), '|'), 2, len(string_split(trim(h), '|')) - 1), lambda c: lower(trim(c))), '¦')) as header from k where n_sep > 0 and last > first""",
    "joined_pages": f"with {SQL_LINES}, q as (select doc_id, page, '<!-- page n=\"' || page || '\" -->' || chr(10) || string_agg(line, chr(10) order by line_no) as chunk from ln group by doc_id, page), d as (select doc_id, string_agg(chunk, '' order by page) as markdown, count(*) as pages from q group by doc_id) select doc_id, pages, length(markdown) as n_chars, md5(markdown) as digest from d",
    "hyphen_evidence": f"""with {SQL_LINES}, h as (select doc_id, line_no, line, line_no % 2 = 0 and regexp_matches(line, '\\p{{L}}$') as head from ln), t as (select *, coalesce(lag(head) over (partition by doc_id order by line_no), false) as tail, list_filter(regexp_split_to_array(line, '[^\\p{{L}}]+'), lambda w: w <> '') as ws from h),
u as (select doc_id, lower(unnest(list_slice(ws, case when tail then 2 else 1 end, len(ws) - case when head then 1 else 0 end))) as word from t)
select doc_id, count(distinct word) as n_words, sum(length(word)) as n_chars from (select distinct doc_id, word from u) x group by doc_id""",
}

"""Queries of the row-level rules, over the corpus's tokens and lines and over samples of what it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import predicates as p
from folia.operators.spans import SQL_LINES, SQL_TOKENS, documents, lines, literal, sql_values, tokens, values

CELLS = [
    "1 250,00 €", "1,250.00", "-12.50", "EUR 1 234,56", "12 345", "12%", "(12.5)", "07.02", "7,02", "+3.10 $", "01.02.2017", "2017-02-01", "31 janvier 2017", "Total HT", "Solde au", "x", "✓", "oui", "Yes",
    "kg", "Unit(s)", "20 °C", "m³", "", " ", "12/34", "1'234.50", "12.345,67", "1 23,45", "Table 2", "Fig. 3 shows", "figure x", "Page : 1", "A123", "10:05", "28MAR", "2 ÷ 10 bar", "230 V", "10m", "n ° 12", "a | b", "back\\slash", "a b", "RCS 123 456 789", "Montant 12,34", "99", "1234", "12.3", "12.345", "£5.00", "5.00£", "abc 12.34 def", "VND 1,000.00",
]
LABELS = ["Date", "Valeur", "Libellé de l'opération", "Débit", "CRÉDIT", "Montant (EUR)", "Qty", "Référence", "Solde", "Saldo", "Descripción", "Fecha valor", "", "N°"]
LINES = [
    "Acme SA - page 2", "Acme SA - page 3", "corps page 1", "Mentions p. 4", "Rapport | Page 2/7", "75002 Paris page 2024", "Page 12", "2/7", " 2 / 7 ", "Page 3/9", "2 sur 7", "12", "1/2/3", "page", "Page x", "© Acme, Page 3", "Titre", "", "p. 12/340", "(page 9)", "| page 8 |",
]
ROWS = ["| a | b |", "| --- | :--: |", "| a \\| b | c |", "plain", "| H<br>1 | <BR/>Two |", "||", "|---|", "| - | x |", " | Trim | ME | "]
URLS = ["see http://e.org/a, and more", "1https://e.org/x", "4Since then", "12 apples", "(http://e.org/b) ok", "<http://e.org/c>", "http://e.org/d.", "end http://e.org/e?q=1&r=2;", "no link", "http://a.b http://c.d:"]
RAW = ["eﬃcient ﬁne", "so­ft", "1 234", "a b", "x y", "a​b", "p‪q", "line sep", "tab\tstays", "bell\x07", "﻿bom", "pri\ue000vate \uf061\uf0a3\uf0b7", "5 €", "€ 5"]
SPACED = ["a  b", "  indent  kept", "a b", "   ", "x     y  z", ""]
WRAPS = [("infor-", "mation de"), ("peut-", "être"), ("Sous-", "Total"), ("fin.", "Suite"), ("self-", " made"), ("1-", "two"), ("a-", "2"), ("rendez-", "vous"), ("x - ", "y")]
NAMES = ["ABCDEF+Wingdings-Regular", "Helvetica", "SymbolMT", "ZapfDingbats", "Times"]
TITLES = ["# Head", "####### no", "#", "Short title", "A line of text that is longer than sixty bytes, so it can not be one", "Ends.", ""]


def _given(spark: SparkSession, texts: list[str], **cols: Column) -> DataFrame:
    """Columns over texts that the corpus has nothing like."""
    return values(spark, texts).select("id", *[c.alias(k) for k, c in cols.items()])


def _over(spark: SparkSession, sf_dir: str, texts: list[str], **cols: Column) -> DataFrame:
    """Columns over texts (by id) and over the distinct lines of the corpus (by digest, without id)."""
    corpus = lines(documents(spark, sf_dir)).select(F.lit(None).cast("int").alias("id"), F.col("line").alias("text")).distinct()
    rows = values(spark, texts).select(F.col("id").cast("int").alias("id"), "text").unionByName(corpus)
    return rows.select("id", F.md5("text").alias("digest"), *[c.alias(k) for k, c in cols.items()])


def _sql(texts: list[str], **cols: str) -> str:
    corpus = "select distinct null::int as id, unnest(string_split(text, chr(10))) as text from documents"
    return f"with every as (select cast(id as int) as id, text from {sql_values(texts)} union all {corpus}) select id, md5(text) as digest, {', '.join(f'{c} as {k}' for k, c in cols.items())} from every"



def _t(x: str = "text") -> str:
    return f"regexp_replace(regexp_replace({x}, {literal('^' + p.WS + '+')}, ''), {literal(p.WS + '+$')}, '')"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {literal(pattern)})"


def _in(x: str, of) -> str:
    return f"{x} in ({', '.join(literal(v) for v in of)})"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {literal(p.WS + '+')}), lambda w: w <> '')"


_EDGE = r"^[€$£ \x{00A0}]+"
_VALUE = _m(f"regexp_replace(regexp_replace({_t()}, {literal(_EDGE)}, ''), {literal(_EDGE[1:] + '$')}, '')", r"^[-0-9.,+%/' \x{00A0}\x{2028}]+$") + f" and {_m('text', '[0-9]')}"
_NUMERIC = _m(f"regexp_replace({_t()}, '[$€£¥,.%()-]|VND', '', 'g')", rf"^(?:[0-9]|{p.WS})+$")
_DATE_SQL = f"({_m(_t(), r'^[0-9]+[./-][0-9]+[./-][0-9]{2,}$')} or (len({_words('text')}) = 3 and {_m(_words('text') + '[1]', '^[0-9]+$')} and {_m(_words('text') + '[3]', '^[0-9]+$')} and {_m(_words('text') + '[2]', chr(92) + 'p{L}')}))"
_UNIT_EDGE = r"[^\p{L}\p{N}%€$£°]+"
_unit = f"regexp_replace(regexp_replace(lower({_t()}), {literal('^' + _UNIT_EDGE)}, ''), {literal(_UNIT_EDGE + '$')}, '')"


def cell_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, numbers, amounts and dates among cells."""
    return _over(spark, sf_dir, CELLS, is_value=p.is_value_cell(F.col("text")), is_numeric=p.is_numeric_cell(F.col("text")), is_amount=p.is_monetary_amount(F.col("text")), is_money=p.is_money(F.col("text")), is_date=p.is_date_like(F.col("text")), is_label=p.is_label(F.col("text")), amount_like=p.is_amount_like(F.col("text")))


def cell_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers, units, measurements, data tokens, captions, data values, and escaped cells."""
    return _over(spark, sf_dir, CELLS, is_marker=p.is_marker(F.col("text")), is_unit=p.is_unit(F.col("text")), is_measurement=p.is_measurement(F.col("text")), has_data=p.has_data_token(F.col("text")), has_value=p.carries_data_value(F.col("text")), is_caption=p.has_caption_prefix(F.col("text")), cell=p.md_cell(F.col("text")))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of token occurs in a document."""
    rows = tokens(documents(spark, sf_dir)).withColumn("text", F.col("token"))
    flags = {"n_numeric": p.is_numeric_cell(F.col("text")), "n_amount": p.is_monetary_amount(F.col("text")), "n_value": p.is_value_cell(F.col("text")), "n_marker": p.is_marker(F.col("text")), "n_unit": p.is_unit(F.col("text")), "n_data": p.carries_data_value(F.col("text"))}
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def ledger_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, LABELS, key=p.ledger_key(F.col("text")), family=p.ledger_family(F.col("text")))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture keys and page counters of lines."""
    return _given(spark, LINES, key=p.furniture_key(F.col("text")), n=p.counter(F.col("text"))["n"], m=p.counter(F.col("text"))["m"])


def corpus_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture keys of all lines, and whether a line can be furniture."""
    rows = lines(documents(spark, sf_dir))
    t = F.col("line")
    ok = t.rlike(r"\p{L}") & ~p.carries_data_value(t) & ~t.rlike(r"^\s*(\||<|#|!\[)") & (p.word_count(t) <= 14)
    return rows.select("doc_id", "line_no", p.furniture_key(t).alias("key"), ok.alias("candidate"))


def pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, ROWS, is_row=p.is_table_row(F.col("text")), is_separator=p.is_separator_row(F.col("text")), n_cells=F.size(p.split_row(F.col("text"))).cast("long"), cells=F.array_join(p.split_row(F.col("text")), "¦"), header=F.array_join(p.header_cells(F.col("text")), "¦"))


def url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, URLS, linked=p.linkify(F.col("text")))


def corpus_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link put behind each first line, then linkified."""
    rows = lines(documents(spark, sf_dir)).filter("line_no = 0")
    return rows.select("doc_id", p.linkify(F.concat(F.lit("1https://e.org/"), F.col("doc_id").cast("string"), F.lit(", "), "line")).alias("linked"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, RAW, normal=p.normalize_text(F.col("text")))


def collapsed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, SPACED, collapsed=p.collapse_spaces(F.col("text")))


def hyphen_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = values(spark, [f"{a}¦{b}" for a, b in WRAPS]).select("id", F.split("text", "¦").alias("t"))
    return pairs.select("id", p.hyphen_join(F.get("t", 0), F.get("t", 1)).alias("how"))


def dingbat_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, NAMES, dingbat=p.is_dingbat_face(F.col("text")))


def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, TITLES, title=p.first_line_is_title(F.col("text")))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading level of every line by its size against the page's body size of 12."""
    rows = lines(documents(spark, sf_dir))
    level = p.heading_level(F.col("line"), F.col("size"), F.lit(12), F.col("bold"))
    return rows.select("doc_id", "line_no", level.alias("level")).filter("level is not null")


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers put before lines by their number, and what is found of them."""
    marks = F.array(*[F.lit(m) for m in ("-", "12.", "(3)", "[4]", "[x]", "•", "word", "123456.", "a)")])
    rows = lines(documents(spark, sf_dir)).withColumn("token", F.get(marks, F.pmod(F.col("line_no"), F.lit(9)).cast("int")))
    return rows.withColumn("kind", p.list_marker(F.col("token"))).groupBy("token", "kind").agg(F.count("*").alias("n"))


_SEP = r"[\-–—·|•©®,;:]"
_KEY = f"""list_aggregate(list_filter(list_transform(range(1, len(w) + 1), lambda i:
 case when i > 1 and lower(regexp_replace(w[i - 1], '[^\\p{{L}}\\p{{N}}]+', '', 'g')) in ('page', 'p')
 and ((i > 2 and regexp_matches(coalesce(w[i - 2], ''), {literal(_SEP)})) or regexp_matches(w[i - 1], {literal(r'^[^\p{L}\p{N}]*' + _SEP)}) or ends_with(w[i - 1], '.'))
 and regexp_matches(w[i], {literal(r'^[.,;:*_()\[\]{}]*[0-9]{1,3}(/[0-9]{1,3})?[.,;:*_()\[\]{}]*$')})
 then case when contains(w[i], '/') then '#/#' else '#' end else lower(regexp_replace(w[i], '[^\\p{{L}}\\p{{N}}]+', '', 'g')) end), lambda k: k <> ''), 'string_agg', ' ')"""
_COUNTER = f"(select id, text, regexp_replace(case when starts_with(l, 'page') then substr(l, 5) else l end, {literal(p.WS + '+')}, '', 'g') as b, starts_with(l, 'page') as marked from (select id, text, lower({_t()}) as l from {sql_values(LINES)}) x)"
_RATIO = "^([0-9]{1,9})(?:/|sur)([0-9]{1,9})$"
_split = "case when len(s) >= 2 then list_slice(s, 2, len(s) - 1) else s end"
# RE2 has no look-behind: escaped pipes are hidden while a row is split
_hidden = f"list_transform(string_split(replace({_t()}, '\\|', chr(1)), '|'), lambda c: replace(c, chr(1), '\\|'))"
_MEASURE = f"({_m('text', '[0-9]')} and ({_m('text', '[÷±×≤≥~]')} or {_m('text', '[0-9]°|°[0-9]')} or len(list_filter({_words('text')}, lambda t: {_in('lower(regexp_replace(regexp_replace(t, ' + literal('^[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}°/]+') + ', ' + literal('') + '), ' + literal('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}°/]+$') + ', ' + literal('') + '))', p.MEASURE_UNITS)})) > 0 or {_m('lower(text)', '[0-9][vwamlgs]')} or {_m('text', '[0-9]' + p.WS + '+[VWA](' + p.WS + '|$)')}))"
_core = r"regexp_replace(regexp_replace(t, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')"
_MARK = f"({_in('t', p.MARKERS)} or {_in('lower(t)', p.MARKER_WORDS)})"
_DATA = f"({_t()} <> '' and ({_m('text', '[€$%₹]|EUR|USD')} or {_m('text', '[' + ''.join(m for m in p.MARKERS if not m.isascii()) + ']')} or len(list_filter({_words('text')}, lambda t: not {_MARK})) = 0 or len(list_filter(list_transform({_words('text')}, lambda t: {_core}), lambda w: w <> '' and ((contains(w, ':') and {_m('w', '[0-9]')}) or {_m('regexp_replace(w, ' + literal('[-,.+%]') + ', ' + literal('') + ', ' + literal('g') + ')', '^[0-9]+$')} or (strlen(w) >= 4 and {_m('w', '[0-9]')} and {_m('w', '[A-Za-z]')})))) > 0))"
_value_of = lambda x: _VALUE.replace("text", x)
_AMOUNT_SQL = lambda x: _m(_t(x), p.AMOUNT)
_MARKER_SQL = lambda x: f"({_in(_t(x), p.MARKERS)} or {_in('lower(' + _t(x) + ')', p.MARKER_WORDS)})"
_UNIT_SQL = lambda x: f"({_in(_unit.replace('text', x), p.UNITS)} or {_in('regexp_replace(' + _unit.replace('text', x) + ', ' + literal('[(]s[)]|[()]') + ', ' + literal('') + ', ' + literal('g') + ')', p.UNITS)})"
_ledger = f"translate(upper(regexp_replace(text, {literal('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, '', 'g')), {literal(p.ACCENTS[0])}, {literal(p.ACCENTS[1])})"
_family = "case " + " ".join(f"when {_m(_ledger, '|'.join(v))} then '{k}'" for k, v in (("amount", p.LEDGER_AMOUNT), ("date", p.LEDGER_DATE), ("value", p.LEDGER_VALUE), ("text", p.LEDGER_TEXT))) + " end"


def _link_sql(x: str) -> str:
    """Links by splitting: a blank or the start before a URL is kept."""
    spaced = f"regexp_replace({x}, '^([0-9]+)(https?://|[A-Z])', '\\1 \\2')"
    return f"""regexp_replace({spaced}, {literal("(^|[^(<])(https?://[^ )><" + chr(34) + "']*[^ )><" + chr(34) + "'.,;:])")}, '\\1[\\2](\\2)', 'g')"""


_normal = "text"
for _k, _v in p.LIGATURES.items():
    _normal = f"replace({_normal}, '{_k}', '{_v}')"
_normal = f"replace({_normal}, chr(173), '')"
_normal = f"regexp_replace({_normal}, '([0-9])[\\x{{00A0}}\\x{{202F}}]', '\\1 ', 'g')"
_normal = f"regexp_replace({_normal}, '[\\x{{00A0}}\\x{{202F}}]([0-9])', ' \\1', 'g')"
_normal = f"translate({_normal}, {literal(p.PRIVATE[0])}, {literal(p.PRIVATE[1])})"
_normal = f"regexp_replace(regexp_replace({_normal}, '[\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '[\\x{{E000}}-\\x{{F8FF}}]', '', 'g')"
_normal = f"regexp_replace({_normal}, {literal(p.STRIPPED)}, '', 'g')"
_cell = f"regexp_replace(regexp_replace({_t()}, '([|\\\\])', '\\\\\\1', 'g'), '[\\r\\n]', ' ', 'g')"
_lvl = f"""case when line_t = '' or length(line_t) > 180 or (ends_with(line_t, '.') and not regexp_matches(line_t, '[A-Za-z]')) or len(string_split(line_t, '. ')) > 2
 or (size < 1.4 * 12 and regexp_matches(regexp_extract(line_t, '\\p{{L}}'), '^\\p{{Ll}}')) or (ends_with(line_t, '.') and length(line_t) > 50) then null
 when size >= 1.6 * 12 or (size >= 1.4 * 12 and bold) then 1 when size >= 1.3 * 12 then 2 when size >= 1.15 * 12 and bold then 3 end"""
_wrap = ", ".join(f"({i}, {literal(a)}, {literal(b)})" for i, (a, b) in enumerate(WRAPS))
_next = r"regexp_extract(regexp_replace(b, " + literal(f"^{p.WS}+") + r", ''), '^\p{L}+')"

QUERIES = {f.__name__: f for f in (cell_kinds, cell_marks, token_kinds, ledger_labels, line_keys, corpus_line_keys, pipe_rows, url_links, corpus_links, normalized_text, collapsed_spaces, hyphen_joins, dingbat_faces, title_lines, headings, list_items)}
ORACLES = {
    "cell_kinds": _sql(CELLS, is_value=_VALUE, is_numeric=_NUMERIC, is_amount=_AMOUNT_SQL("text"), is_money=f"{_m(_t(), p.MONEY)} and not {_m(_t(), '^[0-9][0-9]?[.][0-9][0-9]$')}", is_date=_DATE_SQL,
                       is_label=f"{_m('text', chr(92) + 'p{L}')} and len({_words('text')}) <= 6 and length({_t()}) <= 40 and not {_DATE_SQL}", amount_like=f"{_m('text', '[0-9]')} and {_m('text', '^(?:[-0-9.,+€$£()' + chr(39) + ']|' + p.WS + ')+$')}"),
    "cell_marks": _sql(CELLS, is_marker=_MARKER_SQL("text"), is_unit=_UNIT_SQL("text"), is_measurement=_MEASURE, has_data=_DATA, has_value=_m("text", p.DATA_VALUE), is_caption=_m("text", p.CAPTION),
                       cell=f"case when {_t()} = '' then ' ' else replace({_cell}, chr(8232), '<br>') end"),
    "token_kinds": f"with {SQL_TOKENS} select doc_id, count(*) as n, " + ", ".join(f"count(*) filter (where {c}) as {k}" for k, c in (("n_numeric", _NUMERIC.replace("text", "token")), ("n_amount", _AMOUNT_SQL("token")), ("n_value", _value_of("token")), ("n_marker", _MARKER_SQL("token")), ("n_unit", _UNIT_SQL("token")), ("n_data", _m("token", p.DATA_VALUE)))) + " from tk group by doc_id",
    "ledger_labels": f"select id, {_ledger} as key, {_family} as family from {sql_values(LABELS)}",
    "line_keys": f"select c.id, coalesce({_KEY}, '') as key, cast(case when {_m('b', _RATIO)} then regexp_extract(b, '{_RATIO}', 1) when marked and {_m('b', '^[0-9]{1,9}$')} then b end as bigint) as n, cast(case when {_m('b', _RATIO)} then regexp_extract(b, '{_RATIO}', 2) end as bigint) as m from (select *, {_words('text')} as w from {_COUNTER} y) c",
    "corpus_line_keys": f"with {SQL_LINES} select doc_id, line_no, coalesce({_KEY}, '') as key, {_m('line', chr(92) + 'p{L}')} and not {_m('line', p.DATA_VALUE)} and not {_m('line', '^' + chr(92) + 's*(' + chr(92) + '||<|#|!' + chr(92) + '[)')} and len(w) <= 14 as candidate from (select *, {_words('line')} as w from ln) x",
    "pipe_rows": f"select id, starts_with({_t()}, '|') and ends_with({_t()}, '|') as is_row, len(c) > 0 and len(list_filter(c, lambda x: not regexp_matches({_t('x')}, '^[-:]*-[-:]*$'))) = 0 as is_separator, cast(len(c) as bigint) as n_cells, array_to_string(c, '¦') as cells, array_to_string(list_transform(c, lambda x: lower({_t('regexp_replace(x, ' + literal('(?i)<br(?:>|[/ ' + chr(9) + '][^>]*>)') + ', ' + literal('') + ', ' + literal('g') + ')')})), '¦') as header from (select id, text, {_split} as c from (select id, text, {_hidden} as s from {sql_values(ROWS)}) x) y",
    "url_links": _sql(URLS, linked=_link_sql("text")),
    "corpus_links": f"with {SQL_LINES} select doc_id, {_link_sql(chr(39) + '1https://e.org/' + chr(39) + ' || doc_id || ' + chr(39) + ', ' + chr(39) + ' || line')} as linked from ln where line_no = 0",
    "normalized_text": _sql(RAW, normal=_normal),
    "collapsed_spaces": _sql(SPACED, collapsed="regexp_extract(text, '^ *') || regexp_replace(substr(text, length(regexp_extract(text, '^ *')) + 1), ' +', ' ', 'g')"),
    "hyphen_joins": f"select id, case when not regexp_matches(regexp_replace(a, {literal(p.WS + '+$')}, ''), '\\p{{L}}-$') or {_next} = '' then 'none' when regexp_matches({_next}, '^\\p{{Ll}}') and not {_in(f'lower({_next})', p.COMPOUND_TAILS)} then 'join' else 'keep' end as how from (values {_wrap}) v(id, a, b)",
    "dingbat_faces": _sql(NAMES, dingbat="contains(upper(text), 'SYMBOL') or contains(upper(text), 'DINGBATS') or contains(upper(text), 'WINGDINGS') or contains(upper(text), 'PICTS')"),
    "title_lines": _sql(TITLES, title=f"regexp_matches(string_split(text, chr(10))[1], '^#{{1,6}}( |$)') or (strlen(text) < 60 and {_m('text', '^([' + chr(92) + 'p{L}' + chr(92) + 'p{N}]|' + p.WS + ')*$')})"),
    "headings": f"with {SQL_LINES} select doc_id, line_no, level from (select doc_id, line_no, {_lvl} as level from (select *, {_t('line')} as line_t from ln) x) y where level is not null",
    "list_items": f"with {SQL_LINES} select token, case when token = '[x]' then 'checkbox' when token in ('-', '•') then 'bullet' when token in ('12.', '(3)', '[4]') then 'ordered' end as kind, count(*) as n from (select ['-', '12.', '(3)', '[4]', '[x]', '•', 'word', '123456.', 'a)'][line_no % 9 + 1] as token from ln) x group by all",
}

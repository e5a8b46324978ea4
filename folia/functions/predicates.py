"""Row-level rules on text: each takes and returns a Column and stays in the JVM.

White space is Unicode's White_Space property, spelled out so that other SQL
engines read the same class; letters and digits are \\p{L} and \\p{N} where the
rule is about any script and 0-9 where it is about numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{_SPACES}]"

# fixed values: symbols and words that the rules know
CURRENCY = "€$£"
AMOUNT_SYMBOLS = "€$£¥₫"
AMOUNT_CODES = ("EUR", "USD", "GBP", "CHF", "VND")
MARKERS = ("x", "X", "o", "O", "✓", "✗", "✘", "×", "✩", "★", "●", "○", "◀", "▶", "♦", "√", "₹")
MARKER_WORDS = ("oui", "non", "yes", "ok")
UNITS = (
    "unit", "units", "liter", "liters", "litre", "litres", "kg", "g", "mg", "t", "m", "cm", "mm", "km", "l", "ml", "cl", "dl",
    "s", "sec", "min", "h", "hr", "hrs", "eur", "usd", "gbp", "chf", "%", "€", "$", "£", "pcs", "pce", "pces", "stk", "un", "ex", "ct",
    "boite", "bte", "colis", "paq", "pkg", "bar", "kpa", "mpa", "pa", "mbar", "rpm", "hz", "khz", "mhz", "ghz", "kw", "kwh", "w", "v", "a",
    "kva", "var", "m³", "cm³", "mm²", "cm²", "m²", "µm", "μm", "da", "dan",
)
MEASURE_UNITS = (
    "bar", "kpa", "mpa", "pa", "mbar", "rpm", "hz", "khz", "mhz", "ghz", "kw", "kva", "m³", "cm³", "mm²", "cm²", "m²", "µm", "μm", "kg", "mg", "ml", "cl", "da", "dan",
)
SEPARATORS = "-–—·|•©®,;:"
LEDGER_DATE = ("DATE", "DATUM", "FECHA")
LEDGER_VALUE = ("VALEUR", "VALUE", "VALUTA", "VALOR")
LEDGER_TEXT = ("NATURE", "DESCRIPTION", "OPERATION", "LIBELLE", "DETAIL", "PARTICULAR", "NARRATIVE", "MOTIF", "REFERENCE", "TEXT")
LEDGER_AMOUNT = ("DEBIT", "CREDIT", "MONTANT", "AMOUNT", "BETRAG", "SUMME", "IMPORTE", "SALDO", "BALANCE", "HABEN", "AVERE", "ADDEBITO", "SOLL")
ACCENTS = ("ÀÂÄÁÃÅÇÈÉÊËÎÏÍÌÔÖÓÒÕÙÛÜÚŸÝÑ", "AAAAAACEEEEIIIIOOOOOUUUUYYN")

TRIM = rf"^{WS}+|{WS}+$"
VALUE_CELL = rf"^[0-9.,\-+%/' \x{{00A0}}\x{{2028}}]*[0-9][0-9.,\-+%/' \x{{00A0}}\x{{2028}}]*$"
DATA_VALUE = r"[0-9]{4,}|(^|[^0-9])[0-9]{1,3}[.,][0-9]{2}([^0-9]|$)"
AMOUNT_WRAP = rf"(?:[-+{AMOUNT_SYMBOLS}]|{'|'.join(AMOUNT_CODES)}|{WS})"
AMOUNT = rf"^{AMOUNT_WRAP}*(?:[0-9]+|[0-9]{{1,3}}(?:[ .,'\x{{00A0}}\x{{202F}}][0-9]{{3}})+)[.,][0-9]{{2}}{AMOUNT_WRAP}*$"
GROUP = r"[ .,'\x{00A0}\x{202F}]"
MONEY = rf"^[-+\x{{2212}}]*(?:[0-9]|{GROUP})+[.,][0-9]{{2}}{WS}*[€$£¥%]?$"
MONEY_DATE = r"^[0-9]{1,2}\.[0-9]{2}$"
DATE = rf"^[0-9]+[./-][0-9]+[./-][0-9]{{2,}}$|^[0-9]+{WS}+[^{_SPACES}]*\p{{L}}[^{_SPACES}]*{WS}+[0-9]+$"
AMOUNT_LIKE = rf"^(?:[0-9.,\-+'€$£()]|{WS})*[0-9](?:[0-9.,\-+'€$£()]|{WS})*$"
CAPTION = rf"(?i)^(?:table|figure|fig\.?|tableau){WS}+[^\p{{L}}\p{{N}}{_SPACES}]*[0-9]"
PAGE_NUMBER = r"^[0-9 /.\-]+$"
STRIPPED = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{200B}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# fixed values: characters of the Symbol font by code, which private-use code points repeat from U+F000 on
SYMBOL = {
    0x20: " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_", 0x61: "αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼",
    0xA1: "ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…", 0xC0: "ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈", 0xE5: "∑", 0xF1: "〉∫", 0xFB: "✗✓",
}
# fixed values: characters of the Wingdings font by code, which go before the Symbol font's where the font isn't known
WINGDINGS = {
    0x20: " ", 0x3E: "✇", 0x52: "☼", 0x6F: "□", 0x70: "🞐", 0x75: "◆", 0x76: "❖", 0x77: "⬥", 0x78: "⌧", 0x79: "⮹", 0x7D: "🙶", 0x97: "🙠", 0x9F: "•", 0xA0: "€",
    0xA3: "🞈", 0xA7: "▪", 0xA8: "◻", 0xAE: "✹", 0xB3: "⌑", 0xB7: "•", 0xD8: "⮚", 0xF0: "⇨", 0xFB: "🗶", 0xFC: "✔",
}
_PRIVATE = {at + k: ch for at, run in SYMBOL.items() for k, ch in enumerate(run)} | WINGDINGS
PRIVATE = ("".join(chr(0xF000 + code) for code in _PRIVATE), "".join(_PRIVATE.values()))
DINGBATS = "SYMBOL|ZAPFDINGBATS|WINGDINGS|PICTS"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, TRIM, "")


def words(c: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_value_cell(c: Column) -> Column:
    """A bare number, amount or percentage."""
    return F.regexp_replace(trim(c), r"^[€$£ \x{00A0}]+|[€$£ \x{00A0}]+$", "").rlike(VALUE_CELL)


def is_numeric_cell(c: Column) -> Column:
    """Digits and blanks once currency and number punctuation are gone."""
    return F.regexp_replace(trim(c), r"VND|[$€£¥,.\-%()]", "").rlike(rf"^(?:[0-9]|{WS})+$")


def is_monetary_amount(c: Column) -> Column:
    """One amount with two decimals, well-formed thousands groups and any sign or currency around."""
    return trim(c).rlike(AMOUNT)


def is_money(c: Column) -> Column:
    """An amount of a label/value box; a short unsigned dotted number is a date."""
    return trim(c).rlike(MONEY) & ~trim(c).rlike(MONEY_DATE)


def is_date_like(c: Column) -> Column:
    return trim(c).rlike(DATE)


def is_label(c: Column) -> Column:
    """At most six words and forty characters with a letter, and no date."""
    t = trim(c)
    return t.rlike(r"\p{L}") & (word_count(t) <= 6) & (F.length(t) <= 40) & ~is_date_like(t)


def is_amount_like(c: Column) -> Column:
    return c.rlike(AMOUNT_LIKE)


def is_marker(c: Column) -> Column:
    t = trim(c)
    return t.isin(*MARKERS) | F.lower(t).isin(*MARKER_WORDS)


def is_unit(c: Column) -> Column:
    t = F.regexp_replace(F.lower(trim(c)), r"^[^\p{L}\p{N}%€$£°]+|[^\p{L}\p{N}%€$£°]+$", "")
    return t.isin(*UNITS) | F.regexp_replace(t, r"\(s\)|[()]", "").isin(*UNITS)


def carries_data_value(c: Column) -> Column:
    """A run of four digits or a number with exactly two decimals: never furniture."""
    return c.rlike(DATA_VALUE)


def has_caption_prefix(c: Column) -> Column:
    return c.rlike(CAPTION)


def is_dingbat_face(c: Column) -> Column:
    return F.upper(c).rlike(DINGBATS)


def ledger_key(c: Column) -> Column:
    """Letters and digits in upper case without accents."""
    return F.translate(F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), *ACCENTS)


def ledger_family(c: Column) -> Column:
    """amount, date, value, text or null: what a header label stands for."""
    key = ledger_key(c)
    out = F.lit(None).cast("string")
    for name, found in (("text", LEDGER_TEXT), ("value", LEDGER_VALUE), ("date", LEDGER_DATE), ("amount", LEDGER_AMOUNT)):
        out = F.when(key.rlike("|".join(found)), name).otherwise(out)
    return out


def counter(c: Column) -> Column:
    """struct(n, m) of a pure page-counter line; n is null if it is none."""
    low = F.lower(trim(c))
    marked = low.startswith("page")
    body = F.regexp_replace(F.when(marked, F.substring(low, 5, 1 << 20)).otherwise(low), f"{WS}+", "")
    ratio = r"^([0-9]{1,9})(?:/|sur)([0-9]{1,9})$"
    n = F.when(body.rlike(ratio), F.regexp_extract(body, ratio, 1).try_cast("long")).when(marked & body.rlike("^[0-9]{1,9}$"), body.try_cast("long"))
    m = F.when(body.rlike(ratio), F.regexp_extract(body, ratio, 2).try_cast("long"))
    return F.struct(n.alias("n"), m.alias("m"))


def furniture_key(c: Column) -> Column:
    """Letters and digits of each word in lower case; a page number after a set-off page marker is masked."""
    sep = f"[{SEPARATORS}]".replace("-", "\\-", 1)
    number = r"^[.,;:*_()\[\]{}]*([0-9]{1,3})(/[0-9]{1,3})?[.,;:*_()\[\]{}]*$"
    bare = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))

    def key(toks: Column) -> Column:
        def word(t: Column, i: Column) -> Column:
            before = F.when(i >= 1, F.get(toks, i - 1))
            ahead = F.when(i >= 2, F.get(toks, i - 2))
            marker = bare(before).isin("page", "p")
            off = F.coalesce(ahead.rlike(sep), F.lit(False)) | before.rlike(rf"^[^\p{{L}}\p{{N}}]*{sep}") | before.endswith(".")
            masked = F.coalesce(marker & off, F.lit(False)) & t.rlike(number)
            return F.when(masked, F.when(t.contains("/"), "#/#").otherwise("#")).otherwise(bare(t))

        return F.array_join(F.filter(F.transform(toks, word), lambda w: w != ""), " ")

    return F.get(F.transform(F.array(words(c)), key), 0)


def normalize_text(c: Column) -> Column:
    """Decoded text without soft hyphens, ligature code points, private-use and invisible characters."""
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    c = F.replace(c, F.lit("­"), F.lit(""))
    c = F.regexp_replace(c, r"(?<=[0-9])[\x{00A0}\x{202F}]|[\x{00A0}\x{202F}](?=[0-9])", " ")
    c = F.regexp_replace(c, r"[\x{2028}\x{2029}]", "\n")
    return F.regexp_replace(F.regexp_replace(F.translate(c, *PRIVATE), r"[\x{E000}-\x{F8FF}]", ""), STRIPPED, "")


def collapse_spaces(line: Column) -> Column:
    """Runs of blanks after the indent become one."""
    return F.regexp_replace(line, r"(?<=[^ ]) {2,}", " ")


def md_cell(c: Column) -> Column:
    """A cell on one line with pipes and backslashes escaped; empty ones are a blank."""
    t = F.regexp_replace(F.regexp_replace(trim(c), r"([|\\])", r"\\$1"), "[\r\n]", " ")
    t = F.replace(t, F.lit(" "), F.lit("<br>"))
    return F.when(t == "", " ").otherwise(t)


def split_row(line: Column) -> Column:
    """Cells between unescaped pipes; the outer empty ones go."""
    parts = F.split(trim(line), r"(?<!\\)\|", -1)
    return F.when(F.size(parts) >= 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(parts)


def is_table_row(line: Column) -> Column:
    return trim(line).startswith("|") & trim(line).endswith("|")


def is_separator_row(line: Column) -> Column:
    cells = split_row(line)
    return (F.size(cells) > 0) & F.forall(cells, lambda c: trim(c).rlike("^[-:]*-[-:]*$"))


def header_cells(line: Column) -> Column:
    return F.transform(split_row(line), lambda c: F.lower(trim(F.regexp_replace(c, "(?i)<br(?:>|[/ \t][^>]*>)", ""))))


def linkify(line: Column) -> Column:
    """Leading footnote digits apart from what follows, and bare URLs as links."""
    line = F.regexp_replace(line, r"^([0-9]+)(https?://|[A-Z])", "$1 $2")
    return F.regexp_replace(line, r"""(?<![(<])(https?://[^\s)><"']*?)([.,;:]*)(?=[\s)><"']|$)""", "[$1]($1)$2")


def first_line_is_title(text: Column) -> Column:
    line = F.regexp_replace(F.get(F.split(text, "\n"), 0), "\r$", "")
    return line.rlike("^#{1,6}( |$)") | ((F.octet_length(line) < 60) & line.rlike(rf"^(?:[\p{{L}}\p{{N}}]|{WS})*$"))


def heading_level(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """1 to 3, or null: by size against the body's, with vetoes for sentences and continuations."""
    t = trim(text)
    prose = (t == "") | (F.length(t) > 180) | (t.endswith(".") & ~t.rlike("[A-Za-z]"))
    prose = prose | ((F.length(t) - F.length(F.replace(t, F.lit(". ")))) >= 4)
    first = F.regexp_extract(t, r"\p{L}", 0)
    prose = prose | ((size < 1.4 * body) & first.rlike(r"^\p{Ll}")) | (t.endswith(".") & (F.length(t) > 50))
    level = F.when((size >= 1.6 * body) | ((size >= 1.4 * body) & bold), 1).when(size >= 1.3 * body, 2).when((size >= 1.15 * body) & bold, 3)
    return F.when(~prose, level)


def list_marker(token: Column) -> Column:
    """bullet, ordered, checkbox or null for the first word of a line."""
    ordered = (token.rlike(r"^[0-9]+[.)]$") & (F.octet_length(token) <= 5)) | token.rlike(r"^\([0-9]+\)$|^\[[0-9]+\]$")
    return F.when(token.rlike(r"^\[[xX]\]$"), "checkbox").when(token.isin("-", "*", "•", "●", "+", "◦", "▪"), "bullet").when(ordered, "ordered")


# fixed values: words around a hyphen that is no line wrap
COMPOUND_TAILS = (
    "ce", "il", "elle", "on", "je", "tu", "nous", "vous", "ils", "elles", "t", "en", "y", "ci", "là", "même", "moi", "toi", "soi", "lui", "leur",
    "etre", "être", "dire", "professionnel", "professionnelle", "professionnels", "professionnelles", "tout", "tous", "toute", "toutes", "rien",
    "jamais", "mieux", "moins", "plus",
)
COMPOUND_PREFIXES = (
    "non", "anti", "auto", "co", "contre", "ex", "extra", "inter", "micro", "multi", "post", "pre", "pré", "pro", "semi", "sous", "sur", "self",
    "quasi", "demi", "mi", "vice", "néo", "re", "ci", "pare",
)


def hyphen_join(before: Column, after: Column) -> Column:
    """join (drop the hyphen), keep or none for a line and the next one."""
    wrap = F.regexp_replace(before, rf"{WS}+$", "").rlike(r"\p{L}-$")
    word = F.regexp_extract(F.regexp_replace(after, rf"^{WS}+", ""), r"^\p{L}+", 0)
    fragment = word.rlike(r"^\p{Ll}") & ~F.lower(word).isin(*COMPOUND_TAILS)
    return F.when(~wrap | (word == ""), "none").when(fragment, "join").otherwise("keep")


def is_measurement(c: Column) -> Column:
    """A digit with a range sign, degree, unit word or attached unit letter."""
    units = "|".join(MEASURE_UNITS)
    unit = rf"(?i)(?:^|{WS})[^\p{{L}}\p{{N}}°/{_SPACES}]*(?:{units})[^\p{{L}}\p{{N}}°/{_SPACES}]*(?:{WS}|$)"
    found = c.rlike("[÷±×≤≥~]") | c.rlike("[0-9]°|°[0-9]") | c.rlike(unit) | c.rlike("(?i)[0-9][vwamlgs]") | c.rlike(rf"[0-9]{WS}+[VWA](?:{WS}|$)")
    return c.rlike("[0-9]") & found


def has_data_token(c: Column) -> Column:
    """Currency, percent, marker, time, number or code in a cell."""
    t = trim(c)
    tokens = F.filter(F.transform(words(t), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    plain = lambda w: F.regexp_replace(w, r"[,.\-+%]", "").rlike("^[0-9]+$")
    code = lambda w: (F.octet_length(w) >= 4) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    token = F.exists(tokens, lambda w: (w.contains(":") & w.rlike("[0-9]")) | plain(w) | code(w))
    marks = "[" + "".join(m for m in MARKERS if not m.isascii()) + "]"
    return (t != "") & (t.rlike("[€$%₹]|EUR|USD") | t.rlike(marks) | F.forall(words(t), is_marker) | token)

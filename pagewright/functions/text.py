"""Text functions as columns. Lengths that readers see are counted in grapheme clusters, others in code points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: tab to carriage return, next line, and all separators. In the common part of Java's and RE2's syntax.
WS = r"[\t-\r\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{85}\p{Z}]"
NOT_ALNUM = r"[^\p{L}\p{M}\p{N}]"

# ---- fixed values that results depend on
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
HYPHENATED_STEMS = ("self", "well", "state", "high", "low", "long", "short", "full", "part", "cross", "half")
STANDALONE_NEXT = ("a", "an", "and", "as", "at", "be", "been", "being", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "was", "were", "with")
LIST_ITEM = r"^\s*(?:[-*•]|[0-9]+[.)]|[A-Za-z][.)])\s+"
CHAPTER_HEADING = r"(?i)^(?:(?:Chapter|Part|Book)\s+(?:[0-9]+|[IVXLCDM]+)\b.*|Prologue\b.*|Epilogue\b.*)$"
PURE_PAGE_NUMBER = r"^(?:page\s+)?([0-9]{1,5})(?:\s*(?:of|/)\s*[0-9]{1,5})?$"
DECORATED_NUMBER = r"^(.+?[•·|—–-]\s*)([0-9]{1,5})$"
HTML_HEAD = '<html><head><meta charset="utf-8"><style>\nbody{font-family:-apple-system; line-height:1.7; padding:28px; max-width:800px; margin:auto; color:#1a1a1a;}\nh1{font-size:1.6em; margin-top:0;} p{margin:0 0 1em;}\n</style></head><body><h1>'
# ----


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once a row however often ``body`` uses it."""
    return F.transform(F.array(value), body).getItem(0)


def trim(s: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(s, rf"^{WS}+|{WS}+$", "")


def is_blank(s: Column) -> Column:
    return ~F.coalesce(s, F.lit("")).rlike(NOT_WS)


def word_count(s: Column) -> Column:
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(rf"{NOT_WS}+"))


def graphemes(s: Column) -> Column:
    """Length in user-perceived characters."""
    return F.regexp_count(s, F.lit(r"\X"))


def at_most_graphemes(s: Column, n: int) -> Column:
    """Whether a text has ``n`` user-perceived characters or fewer; looks no further than that into a long one."""
    return s.rlike(rf"\A\X{{0,{n}}}\z")


def visible_count(s: Column) -> Column:
    """Code points that aren't white space; what is counted is the rest, of which texts have less."""
    return F.length(s) - F.regexp_count(s, F.lit(WS))


def alnum_count(s: Column) -> Column:
    return F.length(s) - F.regexp_count(s, F.lit(NOT_ALNUM))


def normalize_newlines(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_controls(s: Column) -> Column:
    """Control and format characters off, but for tab and line feed."""
    return F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\p{Cf}]", "")


def expand_ligatures(s: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), LIGATURES, s)


def finalize_whitespace(s: Column) -> Column:
    """Blanks before line ends off, runs of blanks to one, three or more line feeds to two, both ends trimmed."""
    s = F.regexp_replace(s, r"[ \t]+\n", "\n")
    s = F.regexp_replace(s, r"[ \t]{2,}", " ")
    return trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def dehyphenate(s: Column) -> Column:
    """Words that a hyphen breaks over two lines are joined.

    The hyphen goes, unless the next word has one itself, or the stem or the next word is of the listed kinds. Lines
    that look like list items or headings aren't joined, nor is a next line that doesn't begin with a small letter.
    A fold over the lines: what has been joined may join with the line after it.
    """
    blanks = r"^[ \t\x{A0}\p{Zs}]+|[ \t\x{A0}\p{Zs}]+$"
    bare = lambda x: F.regexp_replace(x, blanks, "")

    def joins(left: Column, right: Column) -> Column:
        heading = (F.regexp_count(left, F.lit(r"\p{L}")) >= 4) & ~left.rlike(r"\p{Ll}")
        stem = F.regexp_extract(left, r"(\p{L}*)-$", 1)
        return left.endswith("-") & (F.length(stem) >= 2) & right.rlike(r"^\p{Ll}") & ~left.rlike(LIST_ITEM) & ~right.rlike(LIST_ITEM) & ~heading

    def joined(left: Column, right: Column) -> Column:
        stem = F.lower(F.regexp_extract(left, r"(\p{L}*)-$", 1))
        word = F.lower(F.regexp_extract(right, r"^[\p{L}-]*", 0))
        keeps = word.contains("-") | stem.isin(*HYPHENATED_STEMS) | word.isin(*STANDALONE_NEXT)
        return F.concat(F.when(keeps, left).otherwise(F.regexp_replace(left, "-$", "")), right)

    def step(a: Column, line: Column) -> Column:
        left, right = bare(a["now"]), bare(line)
        more = a["any"] & joins(left, right)
        now = F.when(more, joined(left, right)).otherwise(line)
        out = F.when(more | ~a["any"], a["out"]).otherwise(F.concat(a["out"], F.array(a["now"])))
        return F.struct(F.lit(True).alias("any"), now.alias("now"), out.alias("out"))

    start = F.struct(F.lit(False).alias("any"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    fold = F.aggregate(F.split(s, "\n"), start, step, lambda a: F.array_join(F.concat(a["out"], F.array(a["now"])), "\n"))
    return F.when(s.contains("-"), fold).otherwise(s)


def clean_page(s: Column, dehyphenates: bool = True) -> Column:
    """A page's text: newlines, controls, ligatures, hyphens at line ends, white space. Null counts as empty."""
    s = expand_ligatures(strip_controls(normalize_newlines(F.coalesce(s, F.lit("")))))
    return finalize_whitespace(dehyphenate(s) if dehyphenates else s)


def escape_html(s: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), HTML_ESCAPES, s)


def html_preview(text: Column, title: Column) -> Column:
    body = F.replace(F.replace(escape_html(text), F.lit("\n\n"), F.lit("</p><p>")), F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit(HTML_HEAD), escape_html(title), F.lit("</h1><p>"), body, F.lit("</p></body></html>"))


def _unicode(s: Column, method: str) -> Column:
    """A text by one of the normal forms of the ICU library that Spark has on its class path; ASCII stays as it is."""
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), s, F.lit(False))).otherwise(s)


def decomposed(s: Column) -> Column:
    """Normal form D, in any script."""
    return _unicode(s, "decompose")


def composed(s: Column) -> Column:
    """Normal form C, in any script."""
    return _unicode(s, "compose")


def fold(s: Column) -> Column:
    """Lower case without diacritics, in any script."""
    return F.regexp_replace(decomposed(F.lower(s)), r"\p{Mn}", "")


def signature(s: Column) -> Column:
    """What two lines have in common that differ in case, accents and blanks only."""
    return fold(F.regexp_replace(trim(s), r"[ \t]+", " "))


def page_number(s: Column) -> Column:
    """A struct of number, template and pure for a line that is a page number or ends in one, else null."""
    low = F.lower(F.regexp_replace(trim(s), r"[ \t]+", " "))
    pure, decorated = F.regexp_extract(low, PURE_PAGE_NUMBER, 1), F.regexp_extract(low, DECORATED_NUMBER, 2)
    prefix = signature(F.regexp_extract(low, DECORATED_NUMBER, 1))
    as_struct = lambda n, t, p: F.struct(n.cast("int").alias("number"), t.alias("template"), F.lit(p).alias("pure"))
    return F.when(pure != "", as_struct(pure, F.lit("page-number"), True)).when((decorated != "") & prefix.rlike(r"\p{L}"), as_struct(decorated, F.concat(prefix, F.lit("#")), False))


def is_short_edge_text(s: Column) -> Column:
    return ~is_blank(s) & at_most_graphemes(trim(s), 100) & (word_count(s) <= 14)


def is_chapter_heading(s: Column) -> Column:
    t = trim(s)
    return t.rlike(CHAPTER_HEADING) & ~at_most_graphemes(t, 3) & at_most_graphemes(t, 119)


def table_cell(s: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return trim(F.regexp_replace(s, rf"{WS}+", " "))


def linearize_row(cells: Column) -> Column:
    """``a. b.`` of the cells that aren't blank; null if none is left."""
    said = F.filter(F.transform(cells, table_cell), lambda c: c != "")
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit(".")))


def linearize_row_with_headers(headers: Column, cells: Column) -> Column:
    """``header: value. ...`` of the cells that aren't blank; a cell without a header stands alone; null if none is left."""
    pair = lambda c, i: F.when(F.coalesce(F.get(headers, i), F.lit("")) != "", F.concat(F.get(headers, i), F.lit(": "), table_cell(c))).otherwise(table_cell(c))
    said = F.filter(F.transform(cells, lambda c, i: F.when(table_cell(c) != "", pair(c, i))), lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit(".")))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the greater length, of composed, lower-cased texts with single blanks; 0 beyond 512 graphemes."""
    a, b = (composed(F.lower(composed(table_cell(x)))) for x in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    beyond = F.greatest(graphemes(a), graphemes(b)) > 512
    return F.when(a == b, F.lit(1.0)).when(beyond, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)

"""Quality rules: a threshold table compiled into one Spark projection.

``rule_metrics`` turns a text column into one struct of counts; ``compile_rules`` turns the threshold table into one
boolean column over those counts; ``apply_rules`` puts both on a table. Everything is a built-in expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: Marks that are cut from words before they are looked up in STOP_WORDS.
MARKS = ".,;:!?\"()'"
#: Frequent function words of English, French, German and Spanish; prose holds some of them in any language of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it not of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui se son sur un une "
    "als auch auf aus das dem den der die ein eine es für im ist mit nicht sich sie und von zu "
    "al como con del el los las lo más no para por su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails the rule where ``numerator > limit * denominator`` (or ``<``) and it has ``at_least`` words."""

    name: str
    numerator: str
    op: str
    limit: float
    denominator: str = ""
    at_least: int = 0


#: The first two are the base rules; the others are the verdict of the method.
BASE_RULES = (
    Rule("too_short", "n_words", "<", 10),
    Rule("repeated_words", "n_repeat_words", ">", 0.20, "n_words"),
)
RULES = (
    Rule("symbols", "n_symbols", ">", 0.10, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 0.02, "n_words", at_least=30),
    Rule("duplicate_lines", "n_dup_lines", ">", 0.50, "n_lines", at_least=30),
    Rule("long_words", "word_chars", ">", 25.0, "n_words"),
    Rule("short_words", "word_chars", "<", 1.5, "n_words"),
)


def _repeat_words(w: Column, size: int) -> Column:
    """Words covered by ``size``-word windows that occur twice or more in the list of words ``w``."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

        start = F.struct(F.lit(-size).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(size), p - a["at"])).alias("n"))
        return F.aggregate(let(ranked, positions), start, step, lambda a: a["n"])

    windows = F.transform(F.slice(w, F.lit(1), F.size(w) - (size - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    unless_distinct = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(w) > size, let(windows, unless_distinct)).otherwise(F.lit(0).cast("long"))


def rule_metrics(text: Column, window: int = 5) -> Column:
    """One struct of counts of a text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words.

    A null or empty text has zeros throughout. Lines are cut at line feeds; only lines with a word count, and every
    one that equals an earlier line of its text is a duplicate. Windows are compared by 64-bit hashes of their words.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda c: c.cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_BLANK))
    plain = words(F.translate(F.lower(t), MARKS, " " * len(MARKS)))
    return F.struct(
        let(words(t), lambda w: F.struct(count(F.size(w)).alias("n_words"), _repeat_words(w, window).alias("n_repeat_words"))).alias("w"),
        count(F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        count(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(count(F.size(x)).alias("n_lines"), count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        count(F.size(F.filter(plain, lambda x: x.isin(STOP_WORDS)))).alias("n_stop_words"),
    )


def _flat(m: Column) -> dict[str, Column]:
    return {k: m[k] for k in ("word_chars", "n_symbols", "n_stop_words")} | {k: m["w"][k] for k in ("n_words", "n_repeat_words")} | {k: m["l"][k] for k in ("n_lines", "n_dup_lines")}


def compile_rules(rules: Sequence[Rule], metrics: dict[str, Column]) -> Column:
    """True where a row fails any rule of the table."""
    failed = F.lit(False)
    for r in rules:
        limit = F.lit(float(r.limit)) * (metrics[r.denominator] if r.denominator else F.lit(1))
        value = metrics[r.numerator].cast("double")
        broken = value > limit if r.op == ">" else value < limit
        failed = failed | (broken & (metrics["n_words"] >= r.at_least) if r.at_least else broken)
    return failed


def apply_rules(docs: DataFrame, text_col: str = "text", out_col: str = "rules", base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with one more struct column: the counts, base_failed and kept.

    All rows and columns stay; a column that is already named ``out_col`` is replaced. Null texts count as empty and
    fail the base rules. Repeated rows are judged each on its own. Percentages of the base rules are compared in
    whole numbers, so that ties fall on the side of keeping.
    """
    out = docs.withColumn(out_col, rule_metrics(F.col(text_col)))
    m = _flat(F.col(out_col))
    base_failed = F.lit(False)
    for r in base:
        value, limit = 100 * m[r.numerator], F.lit(round(100 * r.limit)) * (m[r.denominator] if r.denominator else F.lit(1))
        base_failed = base_failed | (value > limit if r.op == ">" else value < limit)
    flat = [c.alias(k) for k, c in m.items()]
    return out.withColumn(out_col, F.struct(*flat, base_failed.alias("base_failed"), (~base_failed & ~compile_rules(rules, m)).alias("kept")))

"""Line-first cleaning: judge every line, drop failing lines, judge what is left.

Only DataFrame functions. Everything about a document is worked out inside its
row, so there is no shuffle and a hot source or a group of copies costs
nothing extra. Three-word windows are compared by a 64-bit hash inside one
document.

Defined results: null text is empty text; an empty text has no words and
fails. A document whose lines all fail has an empty ``clean_text``. Rows are
never merged, so repeated rows give repeated results. Other columns pass
through ``clean_documents`` unless they carry one of its result names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.tables import SPACE_RUN, bind, text_of, word_list

SYMBOLS = "#*$%&|<>"
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    "n_lines", "n_symbol_lines", "n_shouted_lines", "n_open_lines", "n_menu_lines",
    "n_boilerplate_lines", "n_words_left", "clean_text", "kept",
)


@dataclass(frozen=True)
class LineRules:
    """Bounds of the rules; counts are of words unless named otherwise."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_symbol_percent: int = 20
    line_capital_percent: int = 40
    open_line_words: int = 8
    menu_separators: int = 2
    min_left_percent: int = 50
    ends: str = "[.!?:;,\\u2026\\u3002\\uFF01\\uFF1F\\u061F\\u0964\"'\\u201D\\u2019\\u00BB)\\]][\\x20\\x09-\\x0D]*$"
    separators: str = " (?:\\||>|\\u00BB|\\u00B7|\\u2022) "
    boilerplate: str = (
        "(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|"
        "cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|"
        "click here|sign in|log in|sign up|subscribe (?:now|to our)|skip to (?:main )?content|"
        "back to top|share (?:this|on)|copyright (?:\\(c\\)|\\u00A9|\\d{4})|licensed under the)"
    )


def _left(text: Column, pattern: str) -> Column:
    """Characters that stay when everything matching the pattern goes."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the list."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        paired = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(
                F.transform(
                    F.sequence(F.lit(0), last),
                    lambda k: F.when(
                        (F.get(s, k - 1)["h"] == F.get(s, k)["h"])
                        | (F.get(s, k + 1)["h"] == F.get(s, k)["h"]),
                        F.get(s, k)["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return bind(
                F.sort_array(same),
                lambda p: F.aggregate(
                    F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
                    F.lit(0),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(paired, of_sorted)
        )

    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(n < 3, F.lit(0)).otherwise(bind(windows, covered)).cast("long")


def _lines(text: Column, rules: LineRules) -> Column:
    """Every line that has a word, with its rules."""
    spoken = F.filter(F.split(text, "\n"), lambda l: F.btrim(l, F.lit(" \t\x0b\f\r")) != "")

    def judge(line: Column) -> Column:
        words = F.size(word_list(line))
        length = F.length(line)
        symbol = _left(line, f"[^{SYMBOLS}]+") * 100 > words * rules.line_symbol_percent
        shouted = (words > 1) & (_left(line, "[^A-Z]+") * 100 > length * rules.line_capital_percent)
        opened = (words >= rules.open_line_words) & ~line.rlike(rules.ends)
        menu = F.size(F.split(line, rules.separators)) > rules.menu_separators
        boilerplate = line.rlike(rules.boilerplate)
        return F.struct(
            line.alias("line"), words.alias("words"), symbol.alias("symbol"), shouted.alias("shouted"),
            opened.alias("opened"), menu.alias("menu"), boilerplate.alias("boilerplate"),
        )

    return F.transform(spoken, judge)


def _failed(line: Column) -> Column:
    return line["symbol"] | line["shouted"] | line["opened"] | line["menu"] | line["boilerplate"]


def line_report(text: Column, rules: LineRules = LineRules()) -> Column:
    """All results of one text as a struct."""

    def of_lines(lines: Column) -> Column:
        def hit(rule: str) -> Column:
            return F.size(F.filter(lines, lambda l: l[rule])).cast("long").alias(f"n_{rule}_lines")

        def of_left(left: Column) -> Column:
            return F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda l: l["line"]))))
                .cast("long").alias("n_dup_lines"),
                hit("symbol"), hit("shouted"), hit("opened").alias("n_open_lines"), hit("menu"),
                hit("boilerplate"),
                F.aggregate(left, F.lit(0), lambda t, l: t + l["words"]).cast("long").alias("n_words_left"),
                F.array_join(F.transform(left, lambda l: l["line"]), "\n").alias("clean_text"),
            )

        return bind(F.filter(lines, lambda l: ~_failed(l)), of_left)

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeat_words(words).alias("n_repeat_words"),
            _left(text, SPACE_RUN).cast("long").alias("word_chars"),
            _left(text, f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
            bind(_lines(text, rules), of_lines).alias("lines"),
        )

    return bind(word_list(text), of_words)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Every document with its counts, its verdict and the text without failing lines."""
    other = [c for c in docs.columns if c not in RESULTS]
    report = docs.select(*other, line_report(text_of("text"), rules).alias("__report"))
    n, r = F.col("__report.n_words"), F.col("__report.lines")
    base = (n < rules.min_words) | (
        F.col("__report.n_repeat_words") * 100 > n * rules.max_repeat_percent
    )
    return report.select(
        *other,
        *(F.col(f"__report.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")),
        *(
            r[c].alias(c)
            for c in (
                "n_dup_lines", "n_lines", "n_symbol_lines", "n_shouted_lines", "n_open_lines",
                "n_menu_lines", "n_boilerplate_lines", "n_words_left", "clean_text",
            )
        ),
        base.alias("base_failed"),
        (~base & (r["n_words_left"] * 100 >= n * rules.min_left_percent)).alias("kept"),
    )

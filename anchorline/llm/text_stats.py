"""Text statistics, and rules learned from them that tell prose from lists, tables and junk."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.text import strip
from anchorline.llm import examples, rules
from anchorline.session import materialize

#: Rows of labelled documents that are fitted on at most.
MOST_LABELLED = 6_000

#: Fixed value: what stands before an item of a list.
BULLET = r"^[^\S\n]*(?:[-–—−•●○◦▪■□☐☑✓✔·‣∙*+>»→]+|\[[ xX✓]?\]|\(?\d{1,3}[.):、]|\(?[a-zA-Z][.)]|[①-⑳])[^\S\n]*(?=\S)"
END = r"[.!?…。！？؟][\"'”’»)\]」』]*\s*$"
#: Fixed value: marks that are usual in prose.
MARKS = r"[.,;:!?'\"()\-–—…„“”‘’‚«»¿¡。、！？「」『』・，：；（）%&/]"

#: Rows whose cells hold more words than this on average are no rows of a table.
MOST_CELL_WORDS = 6.0

#: Features the rules may look at, in the order of `features`.
FEATURES = [
    "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "line_end_share", "common_share", "n_lines", "bullet_share", "short_line_share", "grid_share", "grid_cells", "loop_share", "vowel_ratio", "case_flip_ratio",
    "longest_word", "segment_words", "n_segments", "ends_per_segment", "kana_ratio", "letter_ratio", "wide_gap_share", "upper_ratio", "line_words", "cell_words", "brief_line_share", "markup_ratio",
]


def _count(c: Column, rx: str) -> Column:
    return F.regexp_count(c, F.lit(rx)).cast("double")


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _most_even(rows: Column, delimiter: str, least: int) -> Column:
    """The number of delimiters (at least `least`) that most rows agree on: rows, cells. Linear in the sorted counts; one row agrees with itself."""

    def step(acc: Column, n: Column) -> Column:
        run = F.when(n == acc["now"], acc["run"] + 1).otherwise(1)
        better = (n >= least) & (run > acc["rows"])
        return F.struct(n.alias("now"), run.alias("run"), F.when(better, run).otherwise(acc["rows"]).alias("rows"), F.when(better, n).otherwise(acc["cells"]).alias("cells"))

    # A single character is counted by what is gone without it, which needs no pattern.
    number = (lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit("")))) if len(delimiter) == 1 else (lambda x: F.regexp_count(x, F.lit(delimiter)))
    zero = F.struct(F.lit(-1).alias("now"), F.lit(0).alias("run"), F.lit(0).alias("rows"), F.lit(0).alias("cells"))
    return F.aggregate(F.array_sort(F.transform(rows, number)), zero, step, lambda acc: F.struct(acc["rows"].alias("rows"), acc["cells"].alias("cells")))


def _with_loop(one: DataFrame) -> DataFrame:
    """`one` (t, lines) with `loop`: the share of the text that one scrap makes up that it begins or ends with, at least four times over, or of its
    lines that occurred before; a share under a half counts only for a short scrap at the start.

    The scrap is what lies between the text's first (last) characters and their next occurrence, however long it is. Each step is a column
    of its own, so it is computed once."""
    one = one.withColumn("ahead", strip(F.col("t")))
    one = one.withColumns({"n_all": F.length("ahead"), "back": F.reverse("ahead")})
    one = one.withColumn("n_probe", F.least(F.lit(16), F.greatest(F.lit(1), F.expr("n_all div 4").cast("int"))))
    sides = ("ahead", "back")
    one = one.withColumns({f"{c}_period": F.call_function("locate", F.substring(c, F.lit(1), F.col("n_probe")), F.col(c), F.lit(2)) - 1 for c in sides})
    one = one.withColumns({f"{c}_covers": F.when(F.col(f"{c}_period") > 0, F.col("n_all") - F.length(F.replace(c, F.substring(c, F.lit(1), F.col(f"{c}_period")), F.lit("")))).otherwise(0) for c in sides})
    again = F.when(F.size("lines") >= 4, 1 - F.size(F.array_distinct("lines")) / F.size("lines")).otherwise(0.0)
    shares = [F.when((F.col(f"{c}_covers") >= 4 * F.col(f"{c}_period")) & (F.col("n_all") > 0), F.col(f"{c}_covers") / F.col("n_all")).otherwise(0.0) for c in sides]
    short = _div(F.length(F.regexp_extract("t", r"(?s)^\s*(.{1,160}?)\1{3,}", 0)), F.length("t"))  # a short one at the start is found whatever follows
    long = F.greatest(again, *shares)
    return one.withColumn("loop", F.greatest(short, F.when(long >= 0.5, long).otherwise(0.0)))


def statistics(df: DataFrame, key: str, text: str, common: list[str]) -> DataFrame:
    """`key` and statistics of each `text`, all by built-in functions over the whole text.

    n_words, mean_word_len; symbol_ratio, digit_ratio, letter_ratio (of the characters that are no white space; symbols are neither letters,
    digits nor usual marks); n_lines (not blank), line_end_share (lines ending in a sentence mark), common_share (of the words
    in `common`; for text in kana the share of hiragana among its letters); and shares that describe layout. A null, empty or blank
    text has 0 everywhere.
    """
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?|[\u0085\u2028\u2029\x0B\f]", "\n")
    one = df.select(F.col(key).alias("_key"), t.alias("t"))
    bare = F.regexp_replace("t", f"(?m){BULLET}", "")  # what an item is marked with is no word of it
    one = one.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"(?U)\S"))).withColumn("body", F.regexp_replace("t", r"(?U)[\s\p{Z}\p{Cf}]++", ""))
    one = one.withColumn("words", F.regexp_extract_all(F.lower(bare), F.lit(r"[\p{L}\p{M}]++(?:['’][\p{L}\p{M}]++)*+|\p{N}++"), F.lit(0)))
    # Rows of dashes between the rows of a table hold no cells.
    one = one.withColumn("rows", F.filter("lines", lambda x: ~x.rlike(r"^[\s|+:=\-–—_]+$")))
    # Cells: of each delimiter, how many rows have as many as the row that most agree with.
    grids = [_most_even(F.col("rows"), rx, least) for rx, least in (("\t", 1), ("|", 2), (";", 2), (",", 2), (r"(?<=\S) {2,}(?=\S)", 1))]
    one = one.withColumn("grid", F.array_max(F.array(*grids)))
    # A heading is a first line of up to 40 characters before a colon; a longer one is a sentence.
    one = one.withColumn("head", F.regexp_replace(bare, r"^[^\n:：]{1,40}[:：]\s", "\n"))
    one = one.withColumn("segments", F.filter(F.split("head", r"\n|\s/\s|;\s*|\s[|•·●▪∙+>]\s|,\s|、|；|，|(?<=[.!?])\s|(?<=[。！？])"), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    one = _with_loop(one)
    # Sizes that several statistics share are columns of their own, so each is computed once.
    lower = F.lower("body")
    one = one.withColumns({
        "n_body": F.length("body"), "n_words": F.size("words"), "n_lines": F.size("lines"), "n_rows": F.size("rows"), "n_segments": F.size("segments"),
        "n_letters": F.length(F.regexp_replace("body", r"[^\p{L}\p{M}]++", "")), "n_digits": F.length(F.regexp_replace("body", r"\P{N}++", "")),
        "n_plain": F.length(F.regexp_replace("body", rf"(?:[\p{{L}}\p{{M}}\p{{N}}]++|{MARKS})++", "")),
        "n_kana": F.length(F.regexp_replace("body", r"[^\p{IsHiragana}]++", "")), "n_wide": F.length(F.regexp_replace("body", r"[^\p{IsHiragana}\p{IsKatakana}\p{IsHan}ー]++", "")),
        "n_latin": F.length(F.regexp_replace(lower, r"[^a-zà-ÿа-яё]++", "")), "n_vowels": F.length(F.regexp_replace(lower, r"[^aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿаеёиоуыэюя]++", "")),
        "n_known": F.size(F.filter("words", lambda w: w.isin(*common) if common else F.lit(False))),
        "line_size": F.transform(F.transform("lines", lambda x: F.regexp_replace(x, BULLET, "")), lambda x: _count(x, r"[\p{L}\p{M}\p{N}]+") + _count(x, r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]") / 4),
    })
    body, words, lines, n_rows, segments, letters, digits, plain, kana, wide, latin, vowels, known = (
        F.col(c) for c in ("n_body", "n_words", "n_lines", "n_rows", "n_segments", "n_letters", "n_digits", "n_plain", "n_kana", "n_wide", "n_latin", "n_vowels", "n_known")
    )
    lengths = F.transform("words", F.length)
    cell_words = _div(words + wide / 4, n_rows * (F.coalesce(F.col("grid.cells"), F.lit(0)) + 1))
    out = {
        "n_words": words.cast("double"),
        "mean_word_len": _div(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), words),
        "symbol_ratio": _div(plain, body), "digit_ratio": _div(digits, body),
        "line_end_share": _div(F.size(F.filter("lines", lambda x: x.rlike(END))), lines),
        "common_share": F.when(wide * 2 > letters, _div(kana, letters)).otherwise(_div(known, words)),
        "n_lines": lines.cast("double"),
        "bullet_share": _div(F.size(F.filter("lines", lambda x: x.rlike(BULLET))), lines),
        "short_line_share": _div(F.size(F.filter(F.zip_with("lines", "line_size", lambda x, n: (n <= 5) & ~x.rlike(END)), lambda b: b)), lines),
        "grid_share": F.when((n_rows >= 2) & (cell_words <= MOST_CELL_WORDS), _div(F.col("grid.rows"), n_rows)).otherwise(0.0),
        "grid_cells": F.coalesce(F.col("grid.cells").cast("double"), F.lit(0.0)),
        "loop_share": F.col("loop"),
        "vowel_ratio": F.when(latin > 0, _div(vowels, latin)).otherwise(0.4),
        "case_flip_ratio": _div(_count(F.col("t"), r"\p{Ll}\p{Lu}|\p{L}\p{N}|\p{N}\p{L}"), body),
        "longest_word": F.coalesce(F.array_max(F.transform(F.split("t", r"[\s/、。，,]+"), F.length)), F.lit(0)).cast("double"),
        "segment_words": _div(words + wide / 4, segments), "n_segments": segments.cast("double"),
        "ends_per_segment": _div(_count(F.col("t"), r"[.!?…](?=[\s\"'”’»)\]]|$)|[。！？]"), segments),
        "kana_ratio": _div(wide, letters), "letter_ratio": _div(letters, body),
        "wide_gap_share": _div(F.size(F.filter("lines", lambda x: x.rlike(r"\S {2,}\S"))), lines),
        "upper_ratio": _div(F.length(F.regexp_replace("body", r"\P{Lu}++", "")), letters),
        "line_words": _div(words + wide / 4, lines),
        "cell_words": cell_words,
        "markup_ratio": _div(_count(F.col("t"), r"</?[A-Za-z][^<>]*+>|&[A-Za-z]++;|[{}]|\(\)|\w=\S"), words),
        "brief_line_share": F.when(lines >= 3, _div(F.size(F.filter("line_size", lambda n: n <= 5)), lines)).otherwise(0.0),
    }
    blank = body == 0
    return one.select(F.col("_key").alias(key), *[F.when(blank, 0.0).otherwise(out[f]).alias(f) for f in FEATURES])


@cache
def learned(common: tuple[str, ...], seed: int = 7) -> rules.RuleList:
    """Rules learned from the labelled examples (at most MOST_LABELLED of them), whose statistics are computed as any document's."""
    from anchorline.session import get_spark

    rows = examples.labelled(seed)[:MOST_LABELLED]
    frame = get_spark().createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "id bigint, text string, kind string").repartition(8)  # not a local relation, which the driver would work on
    stats = statistics(frame, "id", "text", list(common)).toPandas().sort_values("id")
    return _best(stats[FEATURES].to_numpy(float), [k for _, k in rows], seed)


def _best(x: np.ndarray, kinds: list[str], seed: int, tries: int = 10) -> rules.RuleList:
    """Of rule lists induced with different splits on three quarters of the examples, the one most accurate on the last quarter."""
    test = np.arange(len(x)) % 4 == 3
    kind_of = np.array(kinds, dtype=object)
    found = [rules.induce(x[~test], list(kind_of[~test]), FEATURES, ["junk", "table", "list"], "prose", seed + i) for i in range(tries)]
    return max(found, key=lambda f: ((f.predict(x[test], FEATURES) == kind_of[test]).sum(), -sum(len(t) for t, _ in f.rules)))


def classify(df: DataFrame, key: str, text: str, common: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """Statistics of each document and `kind`: list, table, junk or prose by the learned rules, applied as one CASE expression.

    `common` holds the frequent words (column `word`, a small fixed table; null words are left out). `labelled` replaces the
    built-in examples (text, kind). A null, empty or blank text has kind prose. `key` is passed through as it is. The statistics are written once, the kinds follow from them.
    """
    words = tuple(sorted({r["word"] for r in common.select("word").filter("word is not null").distinct().limit(10_001).collect()}))
    if len(words) > 10_000:
        raise ValueError("more than 10000 common words")
    if labelled is None:
        found = learned(words)
    else:
        frame = df.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled[:MOST_LABELLED])], "id bigint, text string").repartition(8)
        stats = statistics(frame, "id", "text", list(words)).toPandas().sort_values("id")
        found = _best(stats[FEATURES].to_numpy(float), [k for _, k in labelled[:MOST_LABELLED]], 7)
    # Written once: a filter on the kind would otherwise be pushed below the statistics, which would be computed anew for every rule that names them.
    stats = materialize(statistics(df, key, text, list(words)), "text-statistics")
    blank = F.col("letter_ratio") + F.col("symbol_ratio") + F.col("digit_ratio") + F.col("n_lines") == 0
    return stats.withColumn("kind", F.when(blank, F.lit("prose")).otherwise(F.expr(found.to_sql())))

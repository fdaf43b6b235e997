"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Fixed cutoffs misjudge sources whose normal text differs, so each (lang, source) gets its own fences. A sketch is a histogram over
log-linear buckets: exact below 64, five significant bits above, so a quantile is at most 1/32 too low. Such histograms merge by
adding counts: every task pre-aggregates its own rows, and a group with too few rows takes the merged sketch of its language, or of
all rows. A rate may exceed its group's third quartile by ``reach`` times the quartile distance plus a slack; documents within
every fence are kept. One repeated line, such as a heading that is also the last line, counts for nothing.

Defined cases: a null text has no words and fails the base rules; null ``lang`` or ``source`` form groups of their own; repeated
rows each count; an empty table gives an empty result; columns besides doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, column_or_null, settle, small

SYMBOLS = "#*$%&|<>"
#: Metric -> (slack added to the quartile distance, whether low values are fenced too), in the metric's own units.
FENCED = {"symbol_rate": (100, False), "dup_line_rate": (500, False), "repeat_rate": (300, False), "mean_length": (50, True)}


@dataclass(frozen=True)
class Rules:
    """Parameters; rates are per 10,000, the mean word length is in hundredths of a character."""

    min_words: int = 50
    max_repeat_percent: int = 50
    reach: int = 3
    min_group: int = 200


def text_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    step = docs.select("doc_id", column_or_null(docs, "lang", "string").alias("lang"), column_or_null(docs, "source", "string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    step = step.select("doc_id", "lang", "source", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), has_word).alias("lines"))
    step = step.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)), lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("g"), i.alias("p")))).alias("grams"),
    )
    # In sorted order equal windows stand side by side; each one with an equal neighbour is found twice or more.
    step = step.withColumn("found", F.array_sort(F.filter(F.transform("grams", lambda x, i: F.when((F.get("grams", i - 1)["g"] == x["g"]) | (F.get("grams", i + 1)["g"] == x["g"]), x["p"])), lambda p: p.isNotNull())))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate("found", start, lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")))["total"]
    return step.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def bucket(value: Column) -> Column:
    """Lower end of a value's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.when(value < 64, value).otherwise(value - value % F.pow(F.lit(2), shift).cast("long")).cast("long")


def sketch(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by..., metric, bucket, n: one mergeable histogram per group and metric."""
    long = metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("x"))
    return long.groupBy(*by, F.col("x.metric").alias("metric"), bucket(F.col("x.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by..., metric, n and the three quartiles."""
    w = Window.partitionBy(*by, "metric")
    cum = sketches.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("all") * q, F.col("bucket")))
    return cum.groupBy(*by, "metric").agg(F.max("all").alias("n"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


def fences(metrics: DataFrame, rules: Rules) -> DataFrame:
    """lang, source and an array of (metric, low, high); ``metrics`` has the fenced rates."""
    names = list(FENCED)
    fine = settle(sketch(metrics, ["lang", "source"], names))
    own = quartiles(fine, ["lang", "source"])
    lang = quartiles(merge(fine, ["lang"]), ["lang"]).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.struct("n", "q1", "q3").alias("of_lang"))
    every = quartiles(merge(fine, []), []).select(F.col("metric").alias("a_metric"), F.struct("n", "q1", "q3").alias("of_all"))
    own = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")), "left").join(every, F.col("metric") == F.col("a_metric"), "left")
    enough = lambda s: s["n"] >= rules.min_group
    pick = F.when(F.col("n") >= rules.min_group, F.struct("n", "q1", "q3")).when(enough(F.col("of_lang")), F.col("of_lang")).otherwise(F.col("of_all"))
    slack = F.coalesce(*[F.when(F.col("metric") == m, F.lit(s)) for m, (s, _) in FENCED.items()])
    two_sided = F.col("metric").isin([m for m, (_, both) in FENCED.items() if both])
    spread = F.col("pick.q3") - F.col("pick.q1") + slack
    own = own.withColumn("pick", pick).select("lang", "source", "metric", F.when(two_sided, F.col("pick.q1") - rules.reach * spread).alias("low"), (F.col("pick.q3") + rules.reach * spread).alias("high"))
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{m}_{x}") for m in names for x in ("low", "high")])


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    m = text_metrics(docs)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rate = lambda a, b, unit: F.floor(F.col(a) * unit / F.greatest(F.col(b), F.lit(1))).cast("long")
    m = m.withColumns({"base_failed": failed, "symbol_rate": rate("n_symbols", "word_chars", 10_000), "dup_line_rate": F.floor(F.greatest(F.col("n_dup_lines") - 1, F.lit(0)) * 10_000 / F.greatest(F.col("n_lines"), F.lit(1))).cast("long"), "repeat_rate": rate("n_repeat_words", "n_words", 10_000), "mean_length": rate("word_chars", "n_words", 100)})
    # The counts are wanted twice and take nearly all the time; they are a few dozen bytes a document.
    m = settle(m)
    f = fences(m.where(~F.col("base_failed")), rules).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    # The fences have a row per group; they are counted, and broadcast where they are few, so that a hot group stays spread.
    joined = m.join(small(settle(f)), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    within = F.lit(True)
    for name, (_, both) in FENCED.items():
        within = within & F.coalesce(F.col(name) <= F.col(f"{name}_high"), F.lit(True))
        if both:
            within = within & F.coalesce(F.col(name) >= F.col(f"{name}_low"), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"))

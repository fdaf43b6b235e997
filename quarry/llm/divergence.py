"""How the sources of a language differ in their use of terms, in whole numbers.

Terms are taken out of the texts and counted per group (lang, source); every task counts its own rows first, in tables of a bounded size.
From there on all is relational. A language keeps the terms of so many of its documents; groups are crossed with the kept terms of
their language, so that terms that a group lacks count as zeros, and every group gives each term a smoothed share p of ``scale``. Two
groups of one language are compared term by term, by a self-join on language and term whose sums are formed before they are shuffled;
windows rank the results. Counts are dealt out by language and term once, and no later step deals terms anew. Shares are computed in
64 bits where they fit, and in decimals where counts times ``scale`` outgrow them.

Defined cases: null text, lang and source are empty ones; a group whose documents have no terms is there, with a count of 0
everywhere; a language without kept terms has pairs of value 0 and no terms; each row is a document, also when doc_ids repeat; texts of
any length are read whole; ties are ranked by the item in UTF-8 order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column_or_null, give_back, settle, small

#: A term is a run of ASCII letters and of anything beyond ASCII: of a text's bytes in UTF-8, letters become small and other ASCII blank.
FOLDED = bytes(b | 0x20 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))
#: Counts that a task holds before it hands them on.
HELD = 300_000


@dataclass(frozen=True)
class Audit:
    """Terms of ``min_documents`` documents of a language are kept, and ``top`` terms a group are reported."""

    min_documents: int = 10
    top: int = 10
    scale: int = 1_000_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = [*n, None]  # the row without a term says that the group is there
            same = lambda v: pa.array([v], pa.string()).take(pa.array([0] * len(terms)))
            yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, n), 0], pa.int64())], ["lang", "source", "term", "n", "d"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            before, terms = len(n), text.translate(FOLDED).split()
            n.update(terms)
            d.update(set(terms))
            size += len(n) - before
            if size > HELD:
                yield from handed_on()
                size = 0
    yield from handed_on()
    give_back()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), dealt out by lang and term; a group has a row with a null term too."""
    columns = [F.coalesce(column_or_null(docs, c, "string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = bounded_batches(docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    own = rows.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    return own.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(scale: int) -> Column:
    """1 + floor(scale * (n + 2) / (all_n + 2 * v)), in decimals where that outgrows a long."""
    wide = F.expr(f"cast((cast({scale} as decimal(19,0)) * (cast(n as decimal(19,0)) + 2)) div (cast(all_n as decimal(28,0)) + 2 * v) as long)")
    return 1 + F.when(F.col("n") < (1 << 62) // scale, F.expr(f"({scale}L * (n + 2)) div (all_n + 2 * v)")).otherwise(wide)


def divergence(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank."""
    # A row per language and kept term with the groups that have it; the row without a term has all groups of the language.
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("found"))
    found = settle(found.where((F.col("d") >= audit.min_documents) | F.col("term").isNull()).drop("d"))
    groups = settle(found.where("term is null").select("lang", F.col("found.source").alias("sources")))
    kept = found.where("term is not null")
    of_lang = settle(kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count("*").alias("v")))
    own = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("own_n"))
    every = groups.select("lang", F.explode("sources").alias("source"))
    totals = settle(every.join(of_lang.select("lang", "v"), "lang").join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("own_n", F.lit(0)).alias("all_n"), "v"))
    # Every group of the language beside every kept term.
    absent = F.transform(F.array_except("sources", "found.source"), lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))
    dense = kept.repartition("lang", "term").withColumnRenamed("n", "lang_n").join(small(groups), "lang").select("lang", "term", "lang_n", F.explode(F.concat("found", absent)).alias("x"))
    dense = dense.select("lang", "term", "lang_n", "x.source", "x.n").join(small(totals), ["lang", "source"]).select("lang", "term", "lang_n", "source", "n", share(audit.scale).alias("p"))
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    # The value is the same from either side: each pair is summed up once.
    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(other.hint("merge"), (one["lang"] == other["lang"]) & (one["term"] == other["term"]) & (F.col("source") < F.col("item"))).groupBy(one["lang"], "source", "item").agg(F.sum(value).alias("value"))
    sums = settle(sums)
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    # The language's own share, of a term's count in all groups.
    shared = dense.where("n > 0").select("lang", "term", "source", "p", F.col("lang_n").alias("n")).join(small(of_lang), "lang").withColumn("q", share(audit.scale))
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs, terms = pairs.withColumn("rank", F.row_number().over(order)), terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= audit.top)
    return pairs.unionByName(terms)

"""What each filter of a chain removes, in every order of the chain, by inclusion and exclusion (DataFrame functions only).

Every document has a flag per filter. All that is gathered from the documents is, per part, how many fail all filters of each of the
sets of filters (sums of products of flags), so one aggregate with partial sums serves all orders. The rest is arithmetic on these
joint counts. With N(S) the documents that fail all of S and N(empty set) all documents:

* documents that fail filter i and none of P:  the sum over S in P of (-1)^|S| N(S + i)    (removed here, unique failures);
* documents that fail none of P:               the sum over S in P of (-1)^|S| N(S)        (kept);
* the game "documents removed by the filters in P" has the Harsanyi dividends (-1)^(|S|+1) N(S), and a filter's Shapley value is the
  sum of dividend / |S| over the sets with it. Over all k! orders together it removes k! times that: whole numbers.

A document repeats an earlier one if a smaller doc_id has the same text, anywhere in the table. Texts are compared by SHA-256. The
smallest doc_id of each text is found by partial minima, and rows find it again by text *and* doc_id, so that a text with many copies
is dealt to many tasks.

Defined cases: null texts and sources are empty ones, so a null text repeats an empty one; a row without doc_id repeats nothing and
nothing repeats it; rows with one doc_id and one text are no repeats of each other; several labels of one doc_id count as one that has
each mark any of them has, and rows of one doc_id all have its labels; texts of any length are read whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, column_or_null

#: The chain's filters, by letter; E is the one that looks at other documents.
FILTERS = "ABCDE"
MARKS = r"[#$%&*|]"


def text_flags(docs: DataFrame) -> DataFrame:
    """part, doc_id, digest and the failures A to D of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(column_or_null(docs, "source", "string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    capitals = F.char_length(F.regexp_replace("t", "[^A-Z]+", ""))
    return rows.select(
        "part", "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"),
        (F.size("w") < 50).alias("A"),
        (100 * F.size(F.array_distinct("w")).cast("long") < 65 * F.size("w").cast("long")).alias("B"),
        (100 * capitals.cast("long") > 5 * F.char_length("t").cast("long")).alias("C"),
        F.col("t").rlike(MARKS).alias("D"),
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with E: is there a smaller doc_id with this digest?"""
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("f_id")).withColumnRenamed("digest", "f_digest")
    found = rows.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("doc_id") == F.col("f_id")), "left")
    return found.withColumn("E", F.col("doc_id").isNotNull() & F.col("f_id").isNull()).drop("digest", "f_digest", "f_id")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    out = rows.join(marks, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def joint_failures(rows: DataFrame, filters: str, measures: dict[str, Column]) -> DataFrame:
    """part and, per measure, an array with the sum over documents that fail all filters of a set; sets are bits, the first filter's is 1."""
    flags = {f: F.col(f).cast("long") for f in filters}
    members = lambda s: [flags[f] for k, f in enumerate(filters) if s >> k & 1]
    products = {(m, s): F.sum(reduce(lambda a, b: a * b, members(s), weight)).alias(f"{m}_{s}") for m, weight in measures.items() for s in range(1 << len(filters))}
    sums = rows.groupBy("part").agg(*products.values())
    return sums.select("part", *[F.array(*[F.col(f"{m}_{s}") for s in range(1 << len(filters))]).alias(m) for m in measures])


def bits(s: int) -> int:
    return s.bit_count()


def signed_sum(joint: str, within: str, also: str) -> Column:
    """The sum over all sets S in ``within`` of (-1)^|S| N(S and ``also``); the two are columns of bits."""
    return F.expr(f"aggregate(sequence(0, size({joint}) - 1), 0L, (sum, s) -> sum + if((s & {within}) = s, if(bit_count(s) % 2 = 0, 1L, -1L) * {joint}[s | {also}], 0L))")


def audit(joint: DataFrame, filters: str) -> DataFrame:
    """A row per part, order and step, from the joint failures ``n``, ``good`` and ``toxic`` of each part."""
    k = len(filters)
    steps = []
    for order in permutations(range(k)):
        for at, i in enumerate(order):
            before = sum(1 << j for j in order[:at])
            steps.append(F.struct(F.lit("".join(filters[j] for j in order)).alias("filter_order"), F.lit(at + 1).alias("step"), F.lit(1 << i).alias("own"), F.lit(before).alias("before")))
    rows = joint.withColumn("x", F.explode(F.array(*steps))).select("part", *joint.columns[1:], "x.*")
    rows = rows.withColumns({"with_own": F.col("before").bitwiseOR(F.col("own")), "others": F.lit((1 << k) - 1) - F.col("own"), "none": F.lit(0)})
    shares = f"aggregate(sequence(1, size(n) - 1), 0L, (sum, s) -> sum + if((s & own) = own, if(bit_count(s) % 2 = 1, 1L, -1L) * ({factorial(k)}L div bit_count(s)) * n[s], 0L))"
    rows = rows.withColumn("removed", signed_sum("n", "before", "own"))
    return rows.select(
        "part", "filter_order", "step", signed_sum("n", "with_own", "none").alias("kept"), "removed",
        (F.expr("n[own]") - F.col("removed")).alias("redundant"), signed_sum("n", "others", "own").alias("unique_fails"),
        signed_sum("good", "before", "own").alias("good_lost"), signed_sum("toxic", "before", "own").alias("toxic_lost"), F.expr(shares).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = with_labels(with_repeats(text_flags(docs)), labels)
    one = F.lit(1).cast("long")
    joint = joint_failures(rows, FILTERS, {"n": one, "good": F.col("good").cast("long"), "toxic": F.col("toxic").cast("long")})
    return audit(joint, FILTERS)

"""Exact duplicates by digest, with frequent digests split off.

Misra-Gries summaries of every task are merged into at most ``counters`` digests that
hold every digest more frequent than rows / (counters + 1). Their exact counts are
verified. The winners (at most ``counters`` rows of fixed width) are broadcast, so
their rows, however many, are settled where they are; all other digests are rarer
than that bound and go through an ordinary shuffle.

Texts are equal when they are the same after each run of ASCII white space is
replaced by one space; null counts as empty. The row with the smallest id stays (null
ids last; of rows that repeat an id as well, exactly one stays).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelake.llm.common import SPACE, fresh, stash

COUNTERS = 2048


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def merge(counts: pd.Series, counters: int) -> pd.Series:
    """Misra-Gries: keep at most ``counters`` keys by taking the next largest count off all of them."""
    if len(counts) <= counters:
        return counts
    ordered = counts.sort_values(ascending=False)
    left = ordered.iloc[:counters] - ordered.iloc[counters]
    return left[left > 0]


def summary(counters: int):
    def run(frames):
        held = pd.Series(dtype="int64")
        for frame in frames:
            held = merge(held.add(frame["digest"].value_counts(), fill_value=0), counters)
        yield pd.DataFrame({"digest": held.index.astype(str), "n": held.to_numpy().astype("int64")})

    return run


def winners(digests: DataFrame, counters: int) -> DataFrame:
    """Frequent digests with their exact count and smallest id; at most ``counters`` rows.

    ``digests`` has digest, id and row_no. Summaries are merged by adding the counts of a
    digest and taking the (counters + 1)-th largest off; what stays is a superset of the
    digests above rows / (counters + 1). Digests that turn out to be single are dropped.
    """
    parts = digests.select("digest").mapInPandas(summary(counters), "digest string, n bigint")
    top = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1)
    ranked = top.withColumn("over", F.when(F.count("*").over(Window.partitionBy()) > counters, F.min("n").over(Window.partitionBy())).otherwise(0))
    candidates = ranked.filter(F.col("n") > F.col("over")).select("digest")
    exact = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*keeper())
    return exact.filter(F.col("size") > 1)


def keeper() -> list[Column]:
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no"))
    return [first.alias("first"), F.count("*").alias("size")]


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    thin = docs.select(F.col(id_col).alias("id"), F.sha2(normalized(F.col(text_col)), 256).alias("digest"))
    thin = stash(thin.withColumn("row_no", F.monotonically_increasing_id()))
    hot = stash(winners(thin, counters))
    settled = thin.join(F.broadcast(hot), "digest")
    group = Window.partitionBy("digest")
    rest = thin.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    counted = rest.withColumn("size", F.count("*").over(group)).withColumn("first", F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no")).over(group))
    both = settled.select("id", "digest", "row_no", "first", "size").unionByName(counted.select("id", "digest", "row_no", "first", "size"))
    return both.select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("first.row_no")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns. Copies of frequent texts never leave their task."""
    digest, none, first = fresh(docs, "digest", "id_is_null", "first_row")
    sha = F.sha2(normalized(F.col(text_col)), 256)
    hot = stash(winners(docs.select(F.col(id_col).alias("id"), sha.alias("digest"), F.lit(0).alias("row_no")), counters))
    wide = docs.withColumn(digest, sha)
    keep = hot.select(F.col("digest").alias(digest), F.col("first.id").alias(first))
    matched = wide.join(F.broadcast(keep), digest)
    matched = matched.filter(F.col(id_col).eqNullSafe(F.col(first))).drop(first)
    # One row for each digest is left, or a few that repeat the id as well: combined before the shuffle.
    once = matched.groupBy(digest).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    others = wide.join(F.broadcast(keep.select(digest)), digest, "left_anti").withColumn(none, F.col(id_col).isNull())
    order = Window.partitionBy(digest).orderBy(none, id_col)
    single = others.withColumn(first, F.row_number().over(order)).filter(F.col(first) == 1).select(*docs.columns)
    return single.unionByName(once)


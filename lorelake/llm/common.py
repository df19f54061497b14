"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorelake import checkpoints

# Words of the contracts: maximal runs without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
# Rows and size of one Arrow batch; texts average a few kB and may be very long.
BATCH_ROWS, BATCH_SIZE = 256, "4m"


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back.

    Cuts the lineage (a lost executor loses nothing) and fixes row numbers made
    by ``monotonically_increasing_id``. The columnar files allow later column pruning.
    """
    path = checkpoints.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def adding(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of ``df`` that the operator is about to add under the same name."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def text_key(text: Column, seed: str = "") -> Column:
    """A 64-bit key of the text; null and empty differ."""
    return F.xxhash64(F.lit(seed), text.isNull(), text)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str, inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` inside each group in the order (bucket, order), exclusive of the row itself.

    No task sorts a whole group: rows are ordered inside (group, bucket), and only
    one total for each bucket is summed over the group. The bucket must follow the order.
    """
    (base,) = fresh(df, "base_sum")
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias(base))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    keys = [*group, bucket]
    renamed = offsets.select(*[F.col(k).alias(f"{k}__o") for k in keys], base)
    match = [df[k].eqNullSafe(renamed[f"{k}__o"]) for k in keys]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    joined = df.join(renamed, condition).drop(*[f"{k}__o" for k in keys])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return joined.withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(base)

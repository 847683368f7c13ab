"""Helpers shared by the operators: text rules, shared scratch tables, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only where it is unset and Spark runs in this process alone, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lodetrace-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lodetrace-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512):
    """Record batches cut short, so that no more than a few hundred texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def n_words(text: Column) -> Column:
    """Words of a text, a null text having none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_offsets(df: DataFrame, group: str, order: str, ties: list[Column], amounts: dict[str, str], per_cell: int = 64, per_row: int = 256) -> DataFrame:
    """Running sums before each row, over the rows of a group in the order of a 32-bit key.

    df       needs a column ``group``, a column ``order`` (long, 0 to 2**32 - 1, spread evenly) and the amounts.
    ties     breaks ties of the order key; rows equal in all of them are interchangeable.
    amounts  maps a long column to the name of its running sum.

    No window ever holds a whole group: the key range of a group is cut into cells of about
    ``per_cell`` rows, cells into rows of ``per_row`` cells, and sums are carried from the level
    above. A level of a group with n rows has n, n / per_cell and n / (per_cell * per_row) entries.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_cells", F.greatest(F.lit(1), F.ceil(F.col("_n") / per_cell)).cast("long")).select(F.col(group).alias("_g"), "_cells")
    cut = (
        df.join(counts, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
        .withColumn("_cell", F.floor(F.col(order) * F.col("_cells") / F.lit(float(2**32))).cast("long"))
        .drop("_cells")
    )
    cells = cut.groupBy(group, "_cell").agg(*[F.sum(a).alias(s) for a, s in amounts.items()]).withColumn("_row", F.floor(F.col("_cell") / per_row))
    rows = cells.groupBy(group, "_row").agg(*[F.sum(s).alias(s) for s in amounts.values()])

    def before(s: str, w):
        return F.coalesce(F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    w_rows = Window.partitionBy(group).orderBy("_row")
    rows = rows.select(F.col(group).alias("_g"), F.col("_row").alias("_r"), *[before(s, w_rows).alias(f"_up_{s}") for s in amounts.values()])
    w_cells = Window.partitionBy(group, "_row").orderBy("_cell")
    cells = cells.select(group, "_row", "_cell", *[before(s, w_cells).alias(s) for s in amounts.values()])
    cells = cells.join(rows, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_row") == F.col("_r")))
    cells = cells.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), *[(F.col(s) + F.col(f"_up_{s}")).alias(f"_up_{s}") for s in amounts.values()])
    w = Window.partitionBy(group, "_cell").orderBy(F.col(order), *ties)
    inner = cut.select("*", *[before(a, w).alias(s) for a, s in amounts.items()])
    out = inner.join(cells, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")))
    return out.select(*df.columns, *[(F.col(s) + F.col(f"_up_{s}")).alias(s) for s in amounts.values()])

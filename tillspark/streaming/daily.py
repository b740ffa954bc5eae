"""Daily key figures over a stream of sales, compared with a table of past days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tillspark.functions import exprs as X
from tillspark.session import scratch_path

Keys = Sequence[str]

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNNING = "days_before bigint, baseline_mean double, baseline_std double, z_score double, anomaly_status string"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder, or one file, which is read as the only one of its folder's that has its name."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def daily_figures(sales: DataFrame, keys: Keys = (), delay: str = "1 day", ts: str = "date_of_sale") -> DataFrame:
    """Count, sum and mean per day and key. A day closes once events are ``delay`` past its end; later rows for it are
    dropped, and its state is freed. Days are those of UTC, the session time zone the library sets."""
    timed = sales.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    days = timed.groupBy(F.window(ts, "1 day"), *keys).agg(
        X.rows().alias("transaction_count"), F.sum("total_amount").alias("total_sales"), F.count("total_amount").alias("_n")
    )
    return days.select(
        *keys,
        F.to_date("window.start").alias("sale_date"),
        "transaction_count",
        X.double("total_sales").alias("total_sales"),
        X.ratio("total_sales", "_n").alias("avg_transaction_value"),
    )


def baseline(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean and population deviation of past day totals per key."""
    y = X.double("daily_total")
    return daily.groupBy(*keys).agg(F.avg(y).alias("baseline_mean"), F.stddev_pop(y).alias("baseline_std"))


def flag_days(figures: DataFrame, past: DataFrame, keys: Keys, threshold: float = 2.5) -> DataFrame:
    """Z-score of each closed day against its key's past (stream-static join), and a flag beyond ``threshold``. A day whose key
    has no past, or whose past never varies, is ``Unknown``."""
    z = F.try_divide(F.col("total_sales") - F.col("baseline_mean"), F.col("baseline_std"))
    flagged = figures.join(past, list(keys), "left").withColumn("z_score", z)
    status = F.when(F.abs("z_score") > threshold, "Anomaly").when(F.col("z_score").isNotNull(), "Normal").otherwise("Unknown")
    return flagged.withColumn("anomaly_status", status).drop("baseline_mean", "baseline_std")


class _RunningBaseline(StatefulProcessor):
    """Number, mean and squared distance from the mean of the closed days of a key, moved on by each of them (Welford, 1962)."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle) -> None:
        self.known = handle.getValueState("moments", "n bigint, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("sale_date")
        n, mean, m2 = self.known.get() if self.known.exists() else (0, 0.0, 0.0)
        told = []
        for total in days["total_sales"]:
            std = (max(m2, 0.0) / n) ** 0.5 if n else None
            z = (total - mean) / std if std and not pd.isna(total) else None
            status = "Unknown" if z is None else "Anomaly" if abs(z) > self.threshold else "Normal"
            told.append((n, mean if n else None, std, z, status))
            if not pd.isna(total):
                n, gap = n + 1, total - mean
                mean += gap / n
                m2 += gap * (total - mean)
        self.known.update((int(n), float(mean), float(m2)))
        names = [field.split()[0] for field in RUNNING.split(", ")]
        columns = pd.DataFrame(told, columns=names, index=days.index).astype({c: "float64" for c in names[1:4]})
        yield pd.concat([days, columns], axis=1)

    def close(self) -> None:
        pass


def flag_running(figures: DataFrame, keys: Keys, threshold: float = 2.5) -> DataFrame:
    """Closed days of ``daily_figures`` against the closed days of their key before them: ``days_before`` of these, their mean and
    population deviation, z-score and flag. Days with fewer than two different totals before them are ``Unknown``.

    Rows are added up to days before they reach the state, which holds three numbers a key, so a busy key sends one row a day.
    Days close in the order of time; those that close together are put in order. Needs RocksDB as the state store
    (``run_available`` sees to it).
    """
    schema = figures.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in RUNNING.split(", ")))).schema
    return figures.groupBy(*keys).transformWithStateInPandas(_RunningBaseline(threshold), schema, "Append", "None")


def running_batch(days: DataFrame, keys: Keys, threshold: float = 2.5) -> DataFrame:
    """What ``flag_running`` says, from a table of days at once."""
    before = Window.partitionBy(*keys).orderBy("sale_date").rowsBetween(Window.unboundedPreceding, -1)
    told = days.withColumns(
        {"days_before": F.count("total_sales").over(before), "baseline_mean": F.avg("total_sales").over(before), "baseline_std": F.stddev_pop("total_sales").over(before)}
    ).withColumn("z_score", F.try_divide(F.col("total_sales") - F.col("baseline_mean"), F.col("baseline_std")))
    status = F.when(F.abs("z_score") > threshold, "Anomaly").when(F.col("z_score").isNotNull(), "Normal").otherwise("Unknown")
    return told.withColumn("anomaly_status", status)


def days_so_far(sales: DataFrame, keys: Keys, path: str | None = None, checkpoint: str | None = None, delay: str = "1 day", ts: str = "date_of_sale") -> DataFrame:
    """Every day with its newest figures, closed or not, from an update-mode run over what has arrived.

    ``is_open`` tells days that can still change. A micro-batch writes the days it changed to a folder of its own number, so a
    repeated one replaces itself. Further columns: ``arrived_rows`` of the whole stream and ``late_rows``, those that came for a
    day already closed and are in no figure; both are the same in every row.
    """
    spark = sales.sparkSession
    path = path or scratch_path(spark, "stream-open")
    checkpoint = checkpoint or scratch_path(spark, "stream-open-state")
    figures = daily_figures(sales, keys, delay, ts)
    seen = sales.withColumn(ts, F.col(ts).cast("timestamp"))
    counted = seen.groupBy().agg(F.count(ts).alias("arrived_rows"), F.max(ts).alias("newest"))

    def keep(name: str):
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    for name, stream, mode in (("days", figures, "update"), ("counts", counted, "complete")):
        started = stream.writeStream.outputMode(mode).foreachBatch(keep(name)).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        started.awaitTermination()
    rows = spark.read.schema(figures.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/days")
    values = [c for c in figures.columns if c not in (*keys, "sale_date")]
    newest = rows.groupBy(*keys, "sale_date").agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "sale_date", "_v.*")
    counts = spark.read.schema(counted.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/counts").groupBy().agg(F.max_by(F.struct("arrived_rows", "newest"), "batch").alias("c"))
    told = newest.withColumn("_c", counts.select("c").scalar())
    held = newest.agg(F.sum("transaction_count").alias("n")).scalar()
    closes = F.col("sale_date").cast("timestamp") + F.expr("interval 1 day") + F.expr(f"interval {delay}")
    return told.select(
        *newest.columns, (closes > F.col("_c.newest")).alias("is_open"), F.col("_c.arrived_rows").alias("arrived_rows"),
        (F.col("_c.arrived_rows") - held).alias("late_rows"),
    )


def run_available(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived, append closed days to a Parquet table exactly once, and return that table.

    Calling again with the same folders continues where the last run stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream-days")
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # a query keeps the store it was started with
    try:
        started = (
            stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

"""Session helpers: table access, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Bytes up to which it may be broadcast, whatever its number of rows.
BROADCAST_BYTES = 32 << 20
#: Rows of one key beyond which a join spreads them over several tasks.
HOT_ROWS = 200_000
#: Tasks over which rows with a null key are spread.
NULL_SALTS = 1_000


def build_session(cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators are tuned for."""
    n = shuffle_partitions or (os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set a local one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        shared = tempfile.mkdtemp(prefix="corvane-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: the lineage ends, a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan over all cores where its files give work to fewer than half of them, as one small file does; else the scan as it is.

    For plain scans only: their number of tasks is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() < cores else scan


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a value, and those of texts and nested values."""
    sizes = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        kind, name = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif kind.startswith(("array", "struct", "map")):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)))
    return sum(sizes[1:], sizes[0]).cast("long")


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows and BROADCAST_BYTES; reads no further than that many rows."""
    size = df.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()  # one row
    return size.n <= limit and size.b <= BROADCAST_BYTES


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most limit rows and BROADCAST_BYTES; otherwise return it as it is, so that the join shuffles."""
    return F.broadcast(df) if fits(df, limit) else df


def hinted(df: DataFrame, broadcast: bool) -> DataFrame:
    """df, marked for broadcast if a size that bounds its own has been checked."""
    return F.broadcast(df) if broadcast else df


def salted_join(big: DataFrame, lookup: DataFrame, key: str | list[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a skewed big side with a lookup that has one row a key.

    A lookup that fits() is broadcast. Beyond it the keys of more than hot_rows rows are counted (in each task before the shuffle): they are at most
    rows / hot_rows keys. Their lookup rows are repeated once a salt, and the big side's rows of such a key are spread
    over its salts by their whole content; all other keys are joined as they are. Rows with a null in the key match nothing and are spread too.
    """
    keys = [key] if isinstance(key, str) else key
    if fits(lookup):
        return big.join(F.broadcast(lookup), keys, how)
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut(counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    salts = F.when(some_null, NULL_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = big.join(small(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), salts).cast("int")).drop("_salts")
    many = lookup.join(small(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(many, [*keys, "_salt"], how).drop("_salt")

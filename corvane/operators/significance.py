"""Paired significance of two runs over the same topics: sign-flip permutation and bootstrap, with a counter-based generator.

Every draw is a function of (seed, iteration x topics + topic), so iterations are rows of a range and the work spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import cut

# Iterations, tie tolerance, seeds and stride of the generator.
ITERATIONS = 10_000
TIE_EPSILON = 1e-12
STRIDE = 0x6D2B79F5
PERMUTATION_SEED = 0x5EED0D17
BOOTSTRAP_SEED = PERMUTATION_SEED ^ 0x9E3779B9
ALPHA = 0.05
_MASK = 0xFFFFFFFF


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_MASK))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers, without leaving BIGINT."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return _u32(_u32(a * low) + F.shiftleft(a * high % F.lit(1 << 16), 16))


def unit_random(seed: int, counter: Column) -> Column:
    """A number in [0, 1) for each counter: 32-bit mixing by multiplication, xor and shifts."""
    a = _u32(F.lit(seed).cast("long") + _times(F.lit(STRIDE).cast("long"), _u32(counter.cast("long"))))
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = _u32(t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / float(1 << 32)


def paired_differences(previous: DataFrame, latest: DataFrame, metric: str) -> DataFrame:
    """(query_id, topic, diff): latest minus previous; topics numbered by id. Runs over different topics, or topics without a value, are refused."""
    both = previous.select("query_id", F.col(metric).alias("a"), F.lit(1).alias("in_a")).join(latest.select("query_id", F.col(metric).alias("b"), F.lit(1).alias("in_b")), "query_id", "full_outer")
    bad = both.agg(F.expr("count_if(in_a is null)").alias("x"), F.expr("count_if(in_b is null)").alias("y"), F.expr("count_if(in_a = 1 and in_b = 1 and (a is null or b is null))").alias("z")).first()  # one row
    if bad.x or bad.y:
        raise ValueError(f"topics differ: {bad.y} only in the previous run, {bad.x} only in the latest")
    if bad.z:
        raise ValueError(f"{metric} is missing for {bad.z} topics")
    return both.select("query_id", (F.row_number().over(Window.orderBy("query_id")) - 1).alias("topic"), (F.col("b") - F.col("a")).alias("diff"))  # one row a topic of one evaluation


#: Topics of one evaluation whose differences go to every task; each is one number.
TOPICS = 1_000_000
#: Draws that a task holds at once.
DRAWS = 4_000_000


def _random_block(seed: int, counters):
    """unit_random() of an array of counters."""
    import numpy as np

    u = np.uint64
    a = (u(seed) + u(STRIDE) * (counters & u(_MASK))) & u(_MASK)
    t = ((a ^ (a >> u(15))) * (a | u(1))) & u(_MASK)
    t = ((t + (((t ^ (t >> u(7))) * (t | u(61))) & u(_MASK))) & u(_MASK)) ^ t
    return (t ^ (t >> u(14))).astype(np.float64) / float(1 << 32)


def _means(differences: DataFrame, columns: list[str], iterations: int, seed: int, bootstrap: bool) -> DataFrame:
    """(iteration, m: array) of the means of sign-flipped or resampled differences, a value for each column.

    Iterations are rows of a range and spread over the tasks; each draws for blocks of iterations and all topics at once.
    """
    import numpy as np
    import pyarrow as pa

    rows = differences.select("topic", *columns).orderBy("topic").limit(TOPICS + 1).collect()  # one row a topic of one evaluation
    if len(rows) > TOPICS:
        raise ValueError(f"an evaluation has at most {TOPICS} topics")
    n = len(rows)
    spark = differences.sparkSession
    sent = spark.sparkContext.broadcast((np.array([r.topic for r in rows], np.uint64), np.array([[r[c] for c in columns] for r in rows], np.float64).reshape(n, len(columns))))

    def draw(batches):
        topics, values = sent.value
        for batch in batches if n else ():
            its = batch.column(0).to_numpy()
            step = max(1, DRAWS // n)
            for at in range(0, len(its), step):
                it = its[at : at + step].astype(np.uint64)
                u = _random_block(seed, it[:, None] * np.uint64(n) + topics[None, :])
                if bootstrap:
                    pick = np.minimum(n - 1, np.floor(u * n)).astype(np.int64)
                    m = np.stack([values[:, j][pick].sum(1) for j in range(values.shape[1])], 1) / n
                else:
                    m = np.where(u < 0.5, -1.0, 1.0) @ values / n
                yield pa.RecordBatch.from_arrays([pa.array(it.astype(np.int64)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["iteration", "m"])

    tasks = spark.sparkContext.defaultParallelism
    return spark.range(0, iterations, 1, tasks).mapInArrow(draw, "iteration long, m array<double>")


def permutation_test(differences: DataFrame, iterations: int = ITERATIONS, seed: int = PERMUTATION_SEED, columns: tuple[str, ...] = ("diff",)) -> DataFrame:
    """One row a column: topics, mean_difference, p_value = (as extreme + 1) / (iterations + 1); with several columns also `metric`."""
    stats = differences.agg(F.count("*").alias("topics"), *(F.avg(c).alias(c) for c in columns)).first()  # one row
    extreme = [F.count_if(F.abs(F.col("m")[i]) >= abs(stats[c] or 0.0) - TIE_EPSILON).alias(f"e{i}") for i, c in enumerate(columns)]
    made = _means(differences, list(columns), iterations, seed, False).agg(*extreme)
    each = [F.struct(F.lit(c).alias("metric"), F.lit(stats.topics).alias("topics"), F.lit(stats[c]).cast("double").alias("mean_difference"), ((F.col(f"e{i}") + 1) / F.lit(iterations + 1)).alias("p_value")) for i, c in enumerate(columns)]
    out = made.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return out.drop("metric") if columns == ("diff",) else out


def bootstrap_interval(differences: DataFrame, iterations: int = ITERATIONS, seed: int = BOOTSTRAP_SEED, alpha: float = ALPHA, columns: tuple[str, ...] = ("diff",)) -> DataFrame:
    """One row a column: ci_low, ci_high, the means of resampled topics at round(q (n - 1)) of their order; with several columns also `metric`."""
    order = _means(differences, list(columns), iterations, seed, True).agg(*(F.sort_array(F.collect_list(F.col("m")[i])).alias(f"o{i}") for i in range(len(columns))))  # `iterations` numbers a column
    at = lambda i, q: F.try_element_at(f"o{i}", F.lit(int(q * (iterations - 1) + 0.5) + 1))
    each = [F.struct(F.lit(c).alias("metric"), at(i, alpha / 2).alias("ci_low"), at(i, 1 - alpha / 2).alias("ci_high")) for i, c in enumerate(columns)]
    out = order.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return out.drop("metric") if columns == ("diff",) else out


# The metrics of a cross-system pairing.
CROSS_METRICS = ("ndcg10", "recall10", "recall100", "mrr10", "precision10", "average_precision")


def cross_pairing(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = CROSS_METRICS) -> DataFrame:
    """(metric, topics, mean_difference, p_value, ci_low, ci_high, significant) of two systems' topic metrics, b minus a.

    No provenance is compared, as two systems cut the documents in their own way; the topics must be the same. A metric that some topic lacks
    gives a row of nulls.
    """
    both = a.select("query_id", F.lit(1).alias("in_a"), *(F.col(m).alias(f"a_{m}") for m in metrics)).join(b.select("query_id", F.lit(1).alias("in_b"), *(F.col(m).alias(f"b_{m}") for m in metrics)), "query_id", "full_outer")
    both = cut(both.withColumn("topic", F.row_number().over(Window.orderBy("query_id")) - 1))  # one row a topic of one evaluation
    facts = both.agg(F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("lone"), *(F.count_if(F.col(f"a_{m}").isNull() | F.col(f"b_{m}").isNull()).alias(m) for m in metrics)).first()  # one row
    if facts.lone:
        raise ValueError(f"{facts.lone} topics are in one system only")
    there = tuple(m for m in metrics if not facts[m])
    named = a.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    if not there:
        return named.selectExpr("metric", "cast(null as long) topics", "cast(null as double) mean_difference", "cast(null as double) p_value", "cast(null as double) ci_low", "cast(null as double) ci_high", "cast(null as boolean) significant")
    diff = cut(both.select("topic", *((F.col(f"b_{m}") - F.col(f"a_{m}")).alias(m) for m in there)))
    columns = there if len(there) > 1 else (*there, "topic")  # so that the rows name their metric
    rows = permutation_test(diff, columns=columns).join(bootstrap_interval(diff, columns=columns), "metric")
    return named.join(rows, "metric", "left").withColumn("significant", F.col("p_value") < ALPHA)


def paired_verdict(previous: dict, latest: dict, metric: str, load) -> dict:
    """What two runs' history rows allow to be said: {'kind': ...}.

    kind is 'provenance-changed' (with the changes) if a field of scale moved, 'unattributable-run' if a row names no topic file,
    'missing-per-topic' if load(path) gives None, 'topics-differ', 'metric-unavailable', or 'verdict' with the statistics and the arms: the
    treatment fields that moved.
    """
    from corvane.operators import runs

    changes = runs.changed_fields(previous, latest)
    if any(c["kind"] == "scale" for c in changes):
        return {"kind": "provenance-changed", "changed": changes}
    paths = [previous.get("perTopic"), latest.get("perTopic")]
    if None in paths:
        return {"kind": "unattributable-run", "runs": [r.get("ts") for r, p in zip((previous, latest), paths) if p is None]}
    loaded = [load(p) for p in paths]
    if any(df is None for df in loaded):
        return {"kind": "missing-per-topic", "paths": [p for p, df in zip(paths, loaded) if df is None]}
    try:
        diff = cut(paired_differences(*loaded, metric))
    except ValueError as e:
        return {"kind": "topics-differ" if "topics differ" in str(e) else "metric-unavailable", "reason": str(e)}
    test, interval = permutation_test(diff).first(), bootstrap_interval(diff).first()  # one row each
    return {"kind": "verdict", **test.asDict(), **interval.asDict(), "significant": test.p_value < ALPHA, "arms": [c for c in changes if c["kind"] == "treatment"]}

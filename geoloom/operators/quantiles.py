"""Exact percentiles of groups of any size, by selection.

Counts by value buckets narrow each group and percentile to one bucket, again and
again for all groups at once, until few values are left; only those are sorted. No
task ever holds the values of a large group, and equal values are counted, not held.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a round, values that may be sorted in one task, rows of a table of targets that may be broadcast.
BUCKETS, FEW, BROADCAST_ROWS = 256, 20_000, 100_000
RULES = ("linear", "lower", "higher")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept below `spark.checkpoint.dir`."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def position(q: float, n: Column) -> Column:
    """Where the percentile lies among n sorted values, from 0; nearly whole places are whole."""
    at = (n - 1) * q
    return F.when(F.abs(at - F.round(at)) < 1e-9, F.round(at)).otherwise(at)


def percentiles(df: DataFrame, value: str, wanted: Mapping[str, float | Sequence], keys: Sequence[str] = ()) -> DataFrame:
    """keys, `_n` (values of the group) and a column for each entry of `wanted`; groups without a value are absent.

    An entry is a level from 0 to 1, or (level, rule) with the rule linear, lower or
    higher. Missing values and NaN don't count.
    """
    levels = {name: (w, "linear") if isinstance(w, int | float) else tuple(w) for name, w in wanted.items()}
    for q, rule in levels.values():
        if not 0 <= q <= 1 or rule not in RULES:
            raise ValueError(f"{q} and {rule}: a level lies from 0 to 1, a rule is {', '.join(RULES)}")
    names = [f"_g{k}" for k in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    spans = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    ends = {f"{name}:{end}": f(position(q, F.col("_n"))).cast("long") for name, (q, rule) in levels.items() for end, f in (("lower", F.floor), ("higher", F.ceil)) if rule in ("linear", end)}
    targets = spans.select(*names, "_n", F.col("_n").alias("_held"), "_lo", "_hi", F.explode(F.array(*(F.struct(F.lit(t).alias("_t"), c.alias("_rank")) for t, c in ends.items()))).alias("_e")).select(*names, "_n", "_held", "_lo", "_hi", "_e.*")
    # percentiles at one place (_at) among the group's values are one target; _rank is the place among those between its ends
    targets = cut(targets.groupBy(*names, "_n", "_held", "_lo", "_hi", "_rank").agg(F.collect_list("_t").alias("_ts")).withColumn("_at", F.col("_rank")))
    while True:
        state = targets.agg(F.count("*"), F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_held")))).first()
        small = state[0] <= BROADCAST_ROWS
        if (state[1] or 0) <= FEW:
            break
        targets = cut(narrowed(rows, targets, names, small))
    done = targets.where("_lo = _hi").withColumn("_x", F.col("_lo"))
    rest = targets.where("_lo < _hi")
    sorted_values = meeting(rows, rest.select(*names, "_at", "_lo", "_hi"), names, small).groupBy(*names, F.col("_at").alias("_r")).agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    same = [rest[n].eqNullSafe(sorted_values[n]) for n in names] + [rest["_at"] == sorted_values["_r"]]
    taken = rest.join(sorted_values, all_of(same)).select(*(rest[n] for n in names), "_n", F.get("_vs", F.col("_rank").cast("int")).alias("_x"), "_ts")
    found = done.select(*names, "_n", "_x", "_ts").unionByName(taken)
    flat = found.select(*names, "_n", "_x", F.explode("_ts").alias("_t")).groupBy(*names, "_n").agg(*(F.max(F.when(F.col("_t") == t, F.col("_x"))).alias(t) for t in ends))
    out = []
    for name, (q, rule) in levels.items():
        if rule == "linear":
            low, high, at = F.col(f"`{name}:lower`"), F.col(f"`{name}:higher`"), position(q, F.col("_n"))
            out.append(F.when((at == F.floor(at)) | (low == high), low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
        else:
            out.append(F.col(f"`{name}:{rule}`").alias(name))
    return flat.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "_n", *out)


def all_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def meeting(rows: DataFrame, targets: DataFrame, names: Sequence[str], small: bool) -> DataFrame:
    """Targets with the values of their group between their ends."""
    own = targets.select(*(F.col(n).alias(f"t{n}") for n in names), *(c for c in targets.columns if c not in names))
    own = F.broadcast(own) if small else own
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    met = rows.join(own, all_of([*(F.col(n).eqNullSafe(F.col(f"t{n}")) for n in names), inside]))
    return met.drop(*(f"t{n}" for n in names))


def narrowed(rows: DataFrame, targets: DataFrame, names: Sequence[str], small: bool) -> DataFrame:
    """Each target with the ends of the bucket its rank falls into and its rank there."""
    open_ = targets.where(f"_lo < _hi and _held > {FEW}")
    met = meeting(rows, open_, names, small)
    # halves first: the difference of two large values may not be a double; ends by themselves, so that a round always parts them
    share = F.nanvl((F.col("_v") / 2 - F.col("_lo") / 2) / F.nullif(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(0.0)), F.lit(0.5))
    inner = F.least(F.greatest(F.coalesce(share, F.lit(0.5)) * BUCKETS, F.lit(0.0)), F.lit(BUCKETS - 1.0)).cast("int")
    bucket = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), BUCKETS).otherwise(inner)
    by = [*names, "_n", "_at", "_rank"]
    counts = met.groupBy(*by, bucket.alias("_k")).agg(F.count("*").alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_ts").alias("_ts"))
    before = F.sum("_held").over(Window.partitionBy(*by).orderBy("_k")) - F.col("_held")  # at most BUCKETS + 2 rows
    chosen = counts.withColumn("_before", before).where("_rank >= _before and _rank < _before + _held")
    closer = chosen.select(*names, "_n", "_held", "_lo", "_hi", "_at", (F.col("_rank") - F.col("_before")).alias("_rank"), "_ts")
    return closer.unionByName(targets.where(f"not (_lo < _hi and _held > {FEW})").select(closer.columns))

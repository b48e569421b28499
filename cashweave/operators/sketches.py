"""Mergeable sketches in Gold: distinct customers of any period, and quantiles of days to pay.

A sketch per tenant, channel and day is a few kilobytes at most, whatever the number of
sales behind it; questions over a period merge sketches and do not read sales again.
The exact numbers next to them are for checking, and for tenants small enough.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

LG_K = 12
# three standard errors of a HyperLogLog sketch with 2^LG_K registers
HLL_ERROR = 3 * 1.04 / math.sqrt(1 << LG_K)
KLL_K = 800
# what the rank of a KLL quantile may be off: the error at 99 % confidence of a sketch with
# k = 200. With KLL_K the usual error is a quarter of it; compaction is random, so runs differ a little.
KLL_ERROR = 0.0133
QUANTILES = (0.5, 0.9)


# --- distinct customers -------------------------------------------------------


def customer_sketches(sales: DataFrame) -> DataFrame:
    """(tenant_id, channel, transaction_date, customers_sketch): Gold state that any period is answered from."""
    return sales.groupBy("tenant_id", "channel", "transaction_date").agg(
        F.hll_sketch_agg("customer_id", F.lit(LG_K)).alias("customers_sketch")
    )


def period_customers(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated distinct customers per group of sketch rows."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("customers_sketch")).alias("customers"))


def trailing_customers(sketches: DataFrame, days: int = 30) -> DataFrame:
    """Estimated distinct customers of the trailing calendar days, for each day with a sketch.

    A sketch is handed to the days it counts for and merged there, in the map tasks first:
    `days` rows for each day, none for a sale.
    """
    own = sketches.select("tenant_id", "channel", F.col("transaction_date").alias("as_of"))
    reach = sketches.select(
        "tenant_id", "channel", "customers_sketch",
        F.explode(F.sequence("transaction_date", F.date_add("transaction_date", days - 1))).alias("as_of"),
    )
    merged = reach.groupBy("tenant_id", "channel", "as_of").agg(
        F.hll_sketch_estimate(F.hll_union_agg("customers_sketch")).alias("estimate")
    )
    return merged.join(own, ["tenant_id", "channel", "as_of"], "left_semi")


def trailing_customers_exact(sales: DataFrame, days: int = 30) -> DataFrame:
    """The same exactly: a customer counts from a purchase until `days` after the last one that follows in time.

    Sweep line: one event where a customer's spell starts and one after it ends, summed per
    day; no customer is copied to the days it counts for.
    """
    key = ["tenant_id", "channel"]
    bought = sales.where(F.col("customer_id").isNotNull()).select(*key, "customer_id", "transaction_date").distinct()
    own = Window.partitionBy(*key, "customer_id").orderBy("transaction_date")
    day = F.col("transaction_date")
    gone = F.date_add(day, days)  # the first day on which this purchase no longer counts
    events = bought.select(
        *key, "transaction_date",
        F.array(
            F.struct(day.alias("at"), F.when(F.coalesce(F.lag(gone).over(own) < day, F.lit(True)), 1).otherwise(0).alias("sign")),
            F.struct(gone.alias("at"), F.when(F.coalesce(F.lead(day).over(own) > gone, F.lit(True)), -1).otherwise(0).alias("sign")),
        ).alias("e"),
    ).select(*key, F.inline("e"))
    sums = events.groupBy(*key, "at").agg(F.sum("sign").alias("n"))
    so_far = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = sums.select(*key, F.col("at").alias("as_of"), F.sum("n").over(so_far).alias("customers"))
    days_of = sales.select(*key, F.col("transaction_date").alias("as_of")).distinct()
    return days_of.join(counts, [*key, "as_of"], "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


def sketch_error(estimated: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact counts with a flag that the estimate lies within three standard errors (and one customer)."""
    joined = exact.join(estimated, ["tenant_id", "channel", "as_of"], "left")
    near = F.abs(F.col("estimate") - F.col("customers")) <= F.lit(HLL_ERROR) * F.col("customers") + 1
    return joined.select("tenant_id", "channel", "as_of", "customers", F.coalesce(near, F.lit(False)).alias("estimate_within_error"))


# --- quantiles ------------------------------------------------------------------


def wait_sketches(settled: DataFrame) -> DataFrame:
    """(tenant_id, invoice_date, paid, waits_sketch): a mergeable sketch of days to pay for each day of invoices."""
    wait = F.datediff("payment_date", "invoice_date").cast("long")
    paid = settled.where(F.col("payment_date").isNotNull())
    return paid.groupBy("tenant_id", "invoice_date").agg(
        F.count(F.lit(1)).alias("paid"), F.kll_sketch_agg_bigint(wait, F.lit(KLL_K)).alias("waits_sketch")
    )


def wait_quantiles(sketches: DataFrame) -> DataFrame:
    """Median and 90th percentile of days to pay per tenant, from merged sketches."""
    merged = sketches.groupBy("tenant_id").agg(F.sum("paid").alias("paid"), F.kll_merge_agg_bigint("waits_sketch").alias("s"))
    names = [f"p{round(100 * q)}" for q in QUANTILES]
    values = [F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias(n) for n, q in zip(names, QUANTILES)]
    return merged.select("tenant_id", "paid", *values)


def wait_quantiles_checked(settled: DataFrame) -> DataFrame:
    """Exact percentiles, and whether the rank of each sketched one is within the sketch's error.

    A value's rank is a range, from the share below it to the share up to it; all waits are
    counted per tenant, one partial aggregate, with the sketched values joined per tenant.
    """
    estimated = wait_quantiles(wait_sketches(settled))
    names = [f"p{round(100 * q)}" for q in QUANTILES]
    wait = F.datediff("payment_date", "invoice_date").cast("long")
    waits = settled.where(F.col("payment_date").isNotNull()).select("tenant_id", wait.alias("wait"))
    counts = waits.groupBy("tenant_id", "wait").agg(F.count(F.lit(1)).alias("n"))  # few distinct waits
    joined = counts.join(estimated, "tenant_id")
    whole = F.sum("n")
    out = [whole.alias("paid")]
    for name, q in zip(names, QUANTILES):
        below = F.sum(F.when(F.col("wait") < F.col(name), F.col("n")).otherwise(0)) / whole
        upto = F.sum(F.when(F.col("wait") <= F.col(name), F.col("n")).otherwise(0)) / whole
        out.append(F.percentile("wait", F.lit(q), F.col("n")).alias(f"exact_{name}"))
        out.append(((below <= q + KLL_ERROR) & (upto >= q - KLL_ERROR)).alias(f"{name}_within_error"))
    return joined.groupBy("tenant_id").agg(*out)

"""The canonical tables derived from an order/lineitem star schema in Parquet.

Every derivation is a plain function of the given files, so its work grows with
them. Rules that stand in for facts the star schema lacks (payment delays,
stock, obligations) are fixed values of this mapping.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.constants import OUTFLOW, RETAIL, STARTING_BALANCE, WHOLESALE
from cashweave.functions.columns import money, padded_id, total
from cashweave.operators.cash import daily_position
from cashweave.operators.clean import dedupe
from cashweave.operators.ledger import (
    combine,
    daily_party_totals,
    entry,
    expand_entries,
    payment_entry,
    receipt_entry,
    recurring_entries,
)
from cashweave.operators.receivables import invoice_payments
from cashweave.session import checkpointed

# Fixed values of the mapping.
START, END = dt.date(1995, 1, 1), dt.date(2001, 8, 1)
SIGNUP_FROM = dt.date(1995, 1, 1)
RETAIL_SEGMENTS = ("HOUSEHOLD", "FURNITURE")
TERMS = {"AUTOMOBILE": 15, "BUILDING": 30, "MACHINERY": 45}
RESTOCK_SHARE, RESTOCK_DAYS = Decimal("0.9"), 7
TENANTS = 25
# category, description, share of lifetime revenue, cadence, offset, step, due day
OBLIGATIONS = (
    ("rent", "Monthly rent", "0.0001", "monthly", 0, 0, None),
    ("utilities", "Monthly utilities", "0.00002", "monthly", 0, 0, None),
    ("loan_payment", "Equipment loan installment", "0.00003", "monthly", 0, 0, None),
    ("payroll", "Biweekly payroll", "0.0002", "every", 4, 14, None),
    ("inventory_restock", "Bulk prepay", "0.02", "once", 0, 0, dt.date(2000, 10, 8)),
)


def tenant_of(nation_key: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(nation_key.cast("string"), 2, "0"))


class StarTables:
    """Lazily planned canonical tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def _customer(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        terms = F.lit(0)
        for name, days in TERMS.items():
            terms = F.when(segment == name, days).otherwise(terms)
        late = F.col("c_acctbal") < 0
        key = F.col("c_custkey")
        delay = F.when(late, terms + 30 + key % 60).otherwise(F.greatest(F.lit(0), terms - 9 + key % 13))
        return self.raw("customer").select(
            key,
            tenant_of(F.col("c_nationkey")).alias("tenant_id"),
            key.cast("string").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.when(segment.isin(*RETAIL_SEGMENTS), RETAIL).otherwise(WHOLESALE).alias("segment"),
            F.date_sub(F.lit(SIGNUP_FROM), (key % 365).cast("int")).alias("signup_date"),
            terms.cast("int").alias("payment_terms_days"),
            late.alias("chronic_late_payer"),
            F.when(key % 37 != 0, delay.cast("int")).alias("delay_days"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self._customer.drop("c_custkey", "delay_days")

    def _orders(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        if first is not None and last is not None:
            after = last + dt.timedelta(days=1)
            orders = orders.where(
                (F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz"))
                & (F.col("o_orderdate") < F.lit(after).cast("timestamp_ntz"))
            )
        return orders

    def sales(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """Deduplicated sales lines; a period is filtered in the order scan.

        Copies are dropped before the join, so a hot order is already small
        there; orders meet customers first, because lines are the largest side
        and should move once.
        """
        orders = self._orders(first, last)
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_quantity", "l_extendedprice", "l_shipdate",
        )
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        if first is None or last is None:
            lines = dedupe(lines, ["l_orderkey", "l_linenumber"], order)
        else:
            # only lines of the period are worth sorting; as one struct the key is not
            # covered by the join's partitioning, so copies still collapse on the map side
            lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
            keyed = lines.withColumn("line", F.struct("l_orderkey", "l_linenumber"))
            lines = dedupe(keyed, ["line"], order).drop("line")
        buyers = self._customer.select(
            "c_custkey", "tenant_id", "customer_id", F.col("segment").alias("channel"), "delay_days"
        )
        dated = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        retail_method = F.element_at(
            F.array(F.lit("card"), F.lit("cash"), F.lit("mobile_wallet")),
            (F.col("l_orderkey") % 3 + 1).cast("int"),
        )
        keyed = dated.where(F.col("tenant_id").isNotNull())  # required key; joins imply it anyway
        return lines.join(keyed, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "tenant_id",
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
            F.col("o_orderdate").cast("date").alias("transaction_date"),
            "customer_id",
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            money(F.try_divide("l_extendedprice", "l_quantity")).alias("unit_price"),
            money(F.col("l_extendedprice")).alias("total_amount"),
            F.when(F.col("channel") == WHOLESALE, "invoice").otherwise(retail_method).alias("payment_method"),
            "channel",
            "delay_days",
        )

    @cached_property
    def products(self) -> DataFrame:
        """A tenant lists the parts it sold plus the parts whose home it is."""
        sellers = self._orders().join(
            self._customer.select("c_custkey", "tenant_id"), F.col("o_custkey") == F.col("c_custkey")
        )
        sold = (
            self.raw("lineitem").select("l_orderkey", "l_partkey")
            .join(sellers.select("o_orderkey", "tenant_id"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select("tenant_id", F.col("l_partkey").alias("p_partkey"))
        )
        part = self.raw("part")
        home = part.select(tenant_of(F.col("p_partkey") % TENANTS).alias("tenant_id"), "p_partkey")
        listed = sold.unionByName(home).distinct()
        price = money(F.col("p_retailprice"))
        return listed.join(part, "p_partkey").select(
            "tenant_id",
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            money(price * F.lit(Decimal("0.6"))).alias("unit_cost"),
            price.alias("unit_price"),
            (F.col("p_partkey") % 50).cast("int").alias("current_stock"),
            F.col("p_size").alias("reorder_point"),
            (F.col("p_size") * 2).alias("reorder_quantity"),
        )

    @cached_property
    def product_codes(self) -> DataFrame:
        return self.products.withColumn("product_code", padded_id("P", F.col("product_id").cast("bigint")))

    @cached_property
    def spans(self) -> DataFrame:
        return self.raw("nation").select(
            tenant_of(F.col("n_nationkey")).alias("tenant_id"),
            F.lit(START).alias("start_date"),
            F.lit(END).alias("end_date"),
            F.lit(STARTING_BALANCE).alias("starting_balance"),
        )

    @cached_property
    def party_totals(self) -> DataFrame:
        return daily_party_totals(self.sales(), "delay_days")

    def share_totals(self) -> StarTables:
        """Computes the daily totals once, for queries that read them several times."""
        self.party_totals = checkpointed(self.party_totals)
        return self

    @cached_property
    def daily(self) -> DataFrame:
        """Revenue by tenant, day and channel from the daily totals (no counts)."""
        return self.party_totals.groupBy("tenant_id", "transaction_date", "channel").agg(
            F.sum("amount").alias("total_revenue")
        )

    @cached_property
    def _wholesale_totals(self) -> DataFrame:
        # every filter a consumer would imply, so that all of them share one computation
        return self.party_totals.where(
            (F.col("channel") == WHOLESALE) & F.col("customer_id").isNotNull()
        )

    @cached_property
    def invoices(self) -> DataFrame:
        return self._wholesale_totals.select(
            "tenant_id", "customer_id", F.col("transaction_date").alias("invoice_date"),
            F.col("amount").alias("total_amount"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """Same rows as the invoice payments of the ledger, without building the rest of it."""
        paid_on = F.date_add("transaction_date", F.col("delay_days"))
        return invoice_payments(expand_entries(self._wholesale_totals, [payment_entry(paid_on)], F.lit(END)))

    @cached_property
    def obligations(self) -> DataFrame:
        """Duties sized by each tenant's lifetime revenue."""
        revenue = self.party_totals.groupBy("tenant_id").agg(total(F.sum("amount")).alias("revenue"))
        duties = F.array(*[
            F.struct(
                F.lit(category).alias("category"),
                F.lit(text).alias("description"),
                total(F.col("revenue") * F.lit(Decimal(share))).alias("amount"),
                F.lit(cadence).alias("cadence"),
                F.lit(offset).alias("offset_days"),
                F.lit(step).alias("step_days"),
                F.lit(due).cast("date").alias("due_date"),
            )
            for category, text, share, cadence, offset, step, due in OBLIGATIONS
        ])
        return revenue.select("tenant_id", F.inline(duties))

    @cached_property
    def recurring(self) -> DataFrame:
        return recurring_entries(self.obligations, self.spans)

    @cached_property
    def ledger(self) -> DataFrame:
        day = F.col("transaction_date")
        restock = entry(
            F.lit(True), F.date_add(day, RESTOCK_DAYS), OUTFLOW, "inventory_restock",
            F.col("amount") * F.lit(RESTOCK_SHARE), F.lit("Routine restock"),
            customer=F.col("customer_id"), source_day=day,
        )
        paid_on = F.date_add(day, F.col("delay_days"))
        from_sales = expand_entries(
            self.party_totals, [receipt_entry(), payment_entry(paid_on), restock], F.lit(END)
        )
        return combine(from_sales, self.recurring)

    @cached_property
    def position(self) -> DataFrame:
        return daily_position(self.ledger, self.spans)

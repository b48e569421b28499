"""Every query by name: a function of (spark, folder of Parquet tables)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, IntegerType, ShortType

from cashweave.constants import LEDGER_CATEGORIES
from cashweave.operators import aging, as_of, boosted, cash, clean, features, forecast, kpis, ledger, phrases, products, quality, residual_band, sketches, tenant_boosting
from cashweave.operators import receivables as ar
from cashweave.operators import sales
from cashweave.plans import answers
from cashweave.session import checkpointed, written
from cashweave.sources.star_tables import END, StarTables

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered questions.
MONTH = dt.date(1998, 10, 1)
LAST_FULL_MONTH = dt.date(2001, 7, 1)
AS_OF = dt.date(2001, 6, 30)
CATEGORY = "PROMO"
PEAK_MONTHS = (1, 7, 8, 12)
WINDOW = (dt.date(2000, 9, 20), dt.date(2000, 11, 5))

# Two trees of depth 2 over the model's features: which one, where it is cut, the value of each leaf.
FIXED_TREES = boosted.TreeArrays(
    np.array([[8, 4, 0], [5, 9, 2]]),
    np.array([[0.5, -500.25, 4.5], [100.5, -50.25, 6.5]]),
    np.array([[-310.5, -120.25, 240.75, 35.5], [-60.5, 80.25, 150.75, -45.5]]),
)

QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result types any client reads: DOUBLE for decimals, BIGINT for integers."""

    def cast(field):
        if isinstance(field.dataType, DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (IntegerType, ShortType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        return F.col(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])


def query(build: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    """Registers a function of the canonical tables under its own name."""
    QUERIES[build.__name__] = lambda spark, folder: plain(build(StarTables(spark, folder)))
    return build


# --- cleaned tables -------------------------------------------------------


@query
def silver_sales(t):
    return t.sales().drop("delay_days")


@query
def silver_customers(t):
    bronze = t.customers.withColumn("signup_date", F.col("signup_date").cast("string"))
    return clean.to_silver(bronze, "customers")


@query
def silver_products(t):
    codes = t.product_codes.select("tenant_id", "product_id", "product_code")
    return clean.to_silver(t.products, "products").join(codes, ["tenant_id", "product_id"])


@query
def silver_ledger(t):
    bronze = t.ledger.withColumn("entry_date", F.col("entry_date").cast("string"))
    return clean.to_silver(bronze, "cash_ledger")


# --- sales ----------------------------------------------------------------


@query
def daily_sales_summary(t):
    return sales.daily_sales(t.sales())


@query
def sales_summary(t):
    return sales.sales_summary(t.sales())


@query
def channel_revenue_month(t):
    first, last = sales.month_bounds(MONTH)
    return sales.channel_revenue_month(sales.daily_sales(t.sales(first, last)), MONTH)


@query
def channels_last_month(t):
    first, last = sales.month_bounds(LAST_FULL_MONTH)
    month = sales.channel_revenue_month(sales.daily_sales(t.sales(first, last)), LAST_FULL_MONTH)
    return sales.channel_share(month)


@query
def channel_share(t):
    by_channel = t.party_totals.groupBy("tenant_id", "channel").agg(F.sum("amount").alias("revenue"))
    return sales.channel_share(by_channel)


@query
def mtd_revenue(t):
    return sales.month_to_date(sales.daily_sales(t.sales()))


@query
def mtd_revenue_as_of(t):
    first, last = sales.month_bounds(AS_OF)
    return sales.month_to_date(sales.daily_sales(t.sales(first, last)), AS_OF, t.spans)


@query
def yearly_growth(t):
    return sales.yearly_growth(sales.daily_sales(t.sales()))


@query
def seasonality_weekday(t):
    return sales.weekday_seasonality(sales.daily_sales(t.sales()))


@query
def seasonality_month(t):
    return sales.month_seasonality(sales.daily_sales(t.sales()))


@query
def trailing_customers(t):
    lines = t.sales()
    estimated = sketches.trailing_customers(sketches.customer_sketches(lines))
    return sketches.sketch_error(estimated, sketches.trailing_customers_exact(lines))


@query
def revenue_rollup(t):
    return sales.revenue_rollup(t.sales(), t.products)


@query
def retail_receipts(t):
    return sales.retail_receipts(t.sales())


@query
def invoices_by_day(t):
    return sales.invoices_by_day(t.sales())


# --- receivables ----------------------------------------------------------


def _receivables(t, invoices, matcher=ar.match_by_amount):
    return ar.describe_receivables(matcher(invoices, t.payments), t.customers)


@query
def receivables_line_grain(t):
    return _receivables(t, ar.invoice_lines(t.sales()))


@query
def receivables_invoice_grain(t):
    return _receivables(t, t.invoices)


@query
def receivables_fifo(t):
    return _receivables(t, t.invoices, ar.match_first_in_first_out)


@query
def receivables_line_fifo(t):
    return _receivables(t, ar.invoice_lines(t.sales()), ar.match_first_in_first_out)


@query
def at_risk_customers(t):
    return ar.at_risk_customers(_receivables(t, t.invoices)).select(
        "tenant_id", "customer_id", "customer_name", "payment_terms_days",
        "avg_days_to_pay", "avg_days_past_terms", "outstanding_ar",
    )


@query
def late_label_agreement(t):
    return ar.late_label_agreement(_receivables(t, t.invoices))


@query
def receivable_totals(t):
    return ar.receivable_totals(_receivables(t, t.invoices))


@query
def unknown_customer_lookup(t):
    asked = t.customers.select("tenant_id", "customer_name")
    return ar.find_customers(_receivables(t, t.invoices), asked)


@query
def settled_invoices(t):
    return ar.settle_invoices(t.invoices, t.payments)


@query
def wait_quantiles(t):
    return sketches.wait_quantiles_checked(ar.settle_invoices(t.invoices, t.payments))


@query
def open_invoices(t):
    return ar.open_invoices(t.invoices, t.payments, t.customers, AS_OF)


@query
def ar_aging(t):
    return ar.ar_aging(t.invoices, t.payments, t.customers, AS_OF)


@query
def ar_aging_by_day(t):
    return aging.aging_by_day(t.invoices, t.payments, t.customers, t.spans)


# --- products -------------------------------------------------------------


@query
def product_performance(t):
    return products.product_performance(t.products, t.sales())


@query
def reorder_list(t):
    return products.reorder_list(t.products)


@query
def best_sellers(t):
    return products.best_sellers(products.product_performance(t.products, t.sales()))


@query
def best_sellers_by_units(t):
    return products.best_sellers(products.product_performance(t.products, t.sales()), by="units_sold")


@query
def slow_movers(t):
    return products.slow_movers(products.product_performance(t.products, t.sales()))


@query
def category_split(t):
    return products.category_split(products.product_performance(t.products, t.sales()), CATEGORY)


# --- ledger and cash ------------------------------------------------------


@query
def cash_ledger(t):
    return t.ledger


@query
def recurring_entries(t):
    return t.recurring


@query
def seasonal_entries(t):
    """The duties with the utilities' two seasons."""
    factors = F.array(*[F.lit(Decimal("1.15") if month in PEAK_MONTHS else Decimal("1.00")) for month in range(1, 13)])
    return ledger.recurring_entries(t.obligations.withColumn("season", F.when(F.col("category") == "utilities", factors)), t.spans)


@query
def daily_cash_position(t):
    return t.position


@query
def cash_burn_runway(t):
    return cash.burn_runway(t.position)


@query
def cash_burn_runway_7d(t):
    return cash.burn_runway(t.position, rows=7)


@query
def latest_cash_position(t):
    return cash.latest_row(cash.burn_runway(t.position)).select(
        "tenant_id", "position_date", "closing_balance",
        "avg_daily_net_burn_30d", "estimated_cash_runway_days",
    )


@query
def worst_cash_days(t):
    return cash.worst_cash_days(cash.burn_runway(t.position)).select(
        "tenant_id", "rank", "position_date", "closing_balance", "estimated_cash_runway_days"
    )


@query
def lowest_days_overall(t):
    return cash.lowest_days_overall(cash.burn_runway(t.position)).select(
        "tenant_id", "position_date", "closing_balance", "estimated_cash_runway_days"
    )


@query
def balance_extremes(t):
    return cash.balance_extremes(t.position)


@query
def balance_extremes_window(t):
    return cash.balance_extremes(t.position, *WINDOW)


@query
def crunch_days(t):
    return cash.crunch_days(cash.burn_runway(t.position)).select(
        "tenant_id", "position_date", "closing_balance", "estimated_cash_runway_days",
        "low_balance", "short_runway",
    )


def _days_with_entries(t):
    """A series with missing days: only those on which money moved."""
    return t.position.where((F.col("total_inflows") != 0) | (F.col("total_outflows") != 0))


@query
def burn_by_calendar(t):
    return cash.burn_by_calendar(_days_with_entries(t))


@query
def crunch_episodes(t):
    return cash.crunch_episodes(cash.burn_runway(t.position))


@query
def crunch_episodes_with_gaps(t):
    return cash.crunch_episodes(cash.burn_by_calendar(_days_with_entries(t)))


@query
def balance_on_due_days(t):
    """What was in the bank when each invoice fell due, three years later, and when each customer signed up."""
    t.share_totals()
    terms = t.customers.select("tenant_id", "customer_id", "payment_terms_days")
    due = F.date_add("invoice_date", F.col("payment_terms_days"))
    days = [F.struct(F.lit(e).alias("event"), F.date_add(due, n).alias("asked_date")) for e, n in (("due", 0), ("three years later", 1095))]
    due = t.invoices.join(terms, ["tenant_id", "customer_id"]).select("tenant_id", "customer_id", F.inline(F.array(*days)))
    signed = t.customers.select("tenant_id", "customer_id", F.lit("signup").alias("event"), F.col("signup_date").alias("asked_date"))
    return as_of.as_of(due.unionByName(signed), _days_with_entries(t))


@query
def worst_day_causes(t):
    t.share_totals()
    return cash.worst_day_causes(t.position, t.ledger)


# --- headline numbers -----------------------------------------------------


def _header(t):
    t.share_totals()
    position = cash.burn_runway(t.position)
    latest = cash.latest_row(position)
    as_of = latest.select("tenant_id", F.col("position_date").alias("as_of"))
    receivable = _receivables(t, t.invoices)
    header = kpis.kpi_header(
        t.spans,
        latest.select("tenant_id", "closing_balance", "estimated_cash_runway_days"),
        sales.month_to_date(t.daily, as_of),
        ar.receivable_totals(receivable).select("tenant_id", "at_risk_customers"),
        products.reorder_count(t.products),
    )
    return header, latest, receivable


@query
def kpi_header(t):
    return _header(t)[0]


@query
def vocabulary_answers(t):
    header, latest, receivable = _header(t)
    owed = receivable.groupBy("tenant_id").agg(
        F.sum("outstanding_ar").alias("receivables"),
        F.count(F.lit(1)).alias("wholesale_customers"),
    )
    outlook = forecast.checkpoint_summary(forecast.run_rate_forecast(t.position))
    listed = products.product_extremes(products.product_performance(t.products, t.sales()))
    metrics = (
        header.drop("runway_text")
        .join(listed, "tenant_id", "left")
        .join(outlook.drop("at_risk_days", "days"), "tenant_id", "left")
        .join(latest.select("tenant_id", F.col("avg_daily_net_burn_30d").alias("burn_rate")), "tenant_id", "left")
        .join(owed, "tenant_id", "left")
        .join(sales.total_revenue(t.daily), "tenant_id", "left")
    )
    return kpis.answer_terms(metrics)


# Fixed questions of this test mapping; each customer asks one.
ASKED = (
    "How much cash do we have right now?",
    "Which are our at-risk customers, and who owes us money?",
    "What needs restocking? And which products are slow movers?",
    "Show retail revenue next to MONTH TO DATE REVENUE, please",
    "Compare the 30-day forecast with the 90-day forecast and any other forecast",
    "What is our cash runway at this burn rate, or just the runway",
    "Best sellers versus top products by revenue",
    "Nothing of this kind",
)


@query
def question_terms(t):
    text = F.element_at(F.array(*[F.lit(q) for q in ASKED]), (F.col("customer_id").cast("bigint") % len(ASKED) + 1).cast("int"))
    asked = t.customers.select("tenant_id", "customer_id", F.concat_ws(": ", "customer_name", text).alias("question"))
    return phrases.question_metrics(asked).select("tenant_id", "customer_id", "term", "metric", "source_column")


# --- features and forecasts -----------------------------------------------


@query
def forecast_features(t):
    return features.training_rows(features.net_flow_history(t.position))


@query
def time_ordered_split(t):
    rows = features.time_ordered_split(features.training_rows(features.net_flow_history(t.position)))
    return rows.groupBy("tenant_id", "is_train").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("position_date").alias("first_day"),
        F.max("position_date").alias("last_day"),
    )


@query
def run_rate_residuals(t):
    return forecast.run_rate_sigma(t.position).select(
        "tenant_id", "n_val", F.round("mae", 4).alias("mae"), F.round("sigma", 4).alias("sigma")
    )


@query
def run_rate_forecast(t):
    return forecast.run_rate_forecast(t.position)


@query
def residual_band_forecast(t):
    position = checkpointed(t.position)
    edges = residual_band.exact_edges(residual_band.backtest(position))
    return residual_band.with_residual_band(forecast.run_rate_projection(position), edges)


@query
def residual_band_sketches(t):
    errors = checkpointed(residual_band.backtest(t.position))
    return residual_band.edges_checked(errors, residual_band.sketched_edges(residual_band.error_sketches(errors)))


@query
def forecast_checkpoints(t):
    return forecast.checkpoints(forecast.run_rate_forecast(t.position))


@query
def checkpoint_summary(t):
    return forecast.checkpoint_summary(forecast.run_rate_forecast(t.position))


@query
def forecast_risk_rows(t):
    return forecast.risk_rows(forecast.run_rate_forecast(t.position))


@query
def risk_next_60_days(t):
    return forecast.risk_within(forecast.run_rate_forecast(t.position), 60)


@query
def risk_explanation(t):
    return forecast.explain_risk(t.spans, forecast.run_rate_forecast(t.position)).select(
        "tenant_id", "explanation"
    )


@query
def forecast_json(t):
    return forecast.forecast_json(forecast.run_rate_forecast(t.position))


@query
def beyond_horizon_lookup(t):
    days = F.array(*[F.lit(n) for n in (30, 60, 90, 91, 400)])
    asked = t.spans.select("tenant_id", F.explode(days).alias("ahead")).select(
        "tenant_id", F.date_add(F.lit(END), F.col("ahead")).alias("asked_date")
    )
    return forecast.forecast_on(forecast.run_rate_forecast(t.position), asked).select(
        "tenant_id", "asked_date", "forecast_day", "predicted_balance", "in_horizon"
    )


@query
def boosted_cash_forecast(t):
    return boosted.boosted_forecast(features.net_flow_history(t.position))


@query
def tenant_cash_forecast(t):
    return tenant_boosting.tenant_forecast(features.net_flow_history(t.position))


@query
def recursive_forecast(t):
    """The projection of the boosted forecast, with fixed trees instead of fitted ones."""
    history = features.net_flow_history(t.position)
    tenants = t.spans.select("tenant_id", F.lit(1.0).alias("scale"), F.lit(None).cast("double").alias("sigma"))
    return forecast.with_band(boosted.recursive_projection(history, boosted.FittedForecast(FIXED_TREES, tenants)))


# --- checks ---------------------------------------------------------------


@query
def quality_report(t):
    t.share_totals()
    position = cash.burn_runway(t.position)
    lines = t.sales()
    return quality.quality_report(
        quality.duplicate_keys(lines, ["tenant_id", "transaction_id"], "sales_key"),
        quality.duplicate_keys(t.ledger, ["tenant_id", "ledger_id"], "ledger_key"),
        quality.missing_values(lines, ["transaction_id", "transaction_date"], "sales_required"),
        quality.allowed_values(t.ledger, "flow_type", ("inflow", "outflow"), "ledger_flow"),
        quality.allowed_values(t.ledger, "category", LEDGER_CATEGORIES, "ledger_category"),
        quality.position_checks(position),
        quality.latest_balance_agrees(position, t.position),
        quality.balance_from_ledger(t.position, t.ledger, t.spans),
        quality.reorder_agrees(products.product_performance(t.products, lines), t.products),
        quality.lateness_agrees(_receivables(t, t.invoices)),
        tenants=t.spans,
    )


def stored_tables(t):
    """Silver and Gold as a refresh writes them: Gold is computed from written Silver, and both are read back.

    Sales lines are joined once; ledger and position follow from what is written.
    """
    sold = written(t.sales())
    t.party_totals = written(ledger.daily_party_totals(sold, "delay_days"))
    lines, entries, customers, listed = sold.drop("delay_days"), written(t.ledger), written(t.customers), written(t.products)
    position = written(cash.daily_position(entries, t.spans))
    return {
        "silver_products": listed, "silver_customers": customers, "silver_sales_transactions": lines,
        "silver_cash_ledger": entries, "silver_daily_cash_position": position,
        "gold_cash_position": written(cash.burn_runway(position)),
        "gold_product_performance": written(products.product_performance(listed, lines)),
        "gold_customer_receivables": written(ar.receivables(lines, entries, customers, "invoice")),
    }


@query
def stored_quality_report(t):
    """Checks over written tables: all five of Silver, and Gold against Silver."""
    return answers.stored_checks(answers.Stored(t.spark, tables=stored_tables(t).__getitem__))


@query
def table_row_counts(t):
    t.share_totals()
    return quality.row_counts({
        "products": t.products,
        "customers": t.customers,
        "sales_transactions": t.sales(),
        "cash_ledger": t.ledger,
        "daily_cash_position": t.position,
    })


@query
def customer_summary(t):
    return quality.customer_summary(t.customers)

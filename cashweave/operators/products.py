"""Catalogue with lifetime sales and a reorder flag, and the lists read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cashweave.functions.columns import count_where


def product_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("tenant_id", "product_id").agg(
        F.sum("quantity").alias("units_sold"), F.sum("total_amount").alias("total_revenue")
    )


def product_performance(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Every catalogue row, sold or not."""
    return (
        products.join(product_sales(sales), ["tenant_id", "product_id"], "left")
        .withColumn("units_sold", F.coalesce("units_sold", F.lit(0)))
        .withColumn("total_revenue", F.coalesce("total_revenue", F.lit(0)))
        .withColumn("needs_reorder", F.col("current_stock") <= F.col("reorder_point"))
    )


def reorder_list(products: DataFrame) -> DataFrame:
    """Products at or below their reorder point, lowest stock first.

    Works on the catalogue itself: the flag does not depend on sales.
    """
    return (
        products.where(F.col("current_stock") <= F.col("reorder_point"))
        .select("tenant_id", "product_id", "product_name", "category", "current_stock",
                "reorder_point", "reorder_quantity")
        .orderBy("current_stock", "tenant_id", "product_id")
    )


def reorder_count(products: DataFrame) -> DataFrame:
    return products.groupBy("tenant_id").agg(
        count_where(F.col("current_stock") <= F.col("reorder_point")).alias("products_to_reorder")
    )


def _ranked(performance: DataFrame, order, k: int) -> DataFrame:
    """First k products per tenant; each map task forwards only its own first k."""
    by_tenant = Window.partitionBy("tenant_id").orderBy(*order, "product_id")
    return (
        performance.withColumn("rank", F.row_number().over(by_tenant))
        .where(F.col("rank") <= k)
        .select("tenant_id", "rank", "product_id", "product_name", "category",
                "current_stock", "units_sold", "total_revenue")
    )


def best_sellers(performance: DataFrame, by: str = "total_revenue", k: int = 10) -> DataFrame:
    return _ranked(performance, [F.desc(by)], k)


def slow_movers(performance: DataFrame, k: int = 10) -> DataFrame:
    """Fewest units sold; a product that is sold out is not slow."""
    return _ranked(performance.where(F.col("current_stock") != 0), [F.asc("units_sold")], k)


def product_extremes(performance: DataFrame) -> DataFrame:
    """Revenue of the best seller and units of the slowest mover still in stock."""
    in_stock = F.col("current_stock") != 0
    return performance.groupBy("tenant_id").agg(
        F.max("total_revenue").alias("best_seller_revenue"),
        F.min(F.when(in_stock, F.col("units_sold"))).alias("slowest_units"),
    )


def category_split(performance: DataFrame, category: str) -> DataFrame:
    """Products and sales inside one category against all others, per tenant.

    Sales are already one row per product here, so the split needs no join with
    sales lines. A product without a category counts as outside.
    """
    inside = F.coalesce(F.col("category") == category, F.lit(False))
    return performance.groupBy("tenant_id", inside.alias("in_category")).agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("units_sold").alias("units_sold"),
        F.sum("total_revenue").alias("total_revenue"),
    )

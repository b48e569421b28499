"""The five source tables: columns as read from CSV, keys, and Silver rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

# Money is exact: invoices and payments are matched on equal amounts.
MONEY = DecimalType(18, 2)
# Sums of money, of a tenant with any number of rows.
TOTAL = DecimalType(28, 2)
# A price for one unit may have fractions of a cent.
PRICE = DecimalType(18, 6)
# Files are read wider, so that what does not fit is rejected and not rounded.
READ = DecimalType(38, 12)

_TEXT, _INT, _BOOL = StringType(), IntegerType(), BooleanType()


@dataclass(frozen=True)
class SourceTable:
    """One input file: typed columns, natural key, and columns holding ISO dates."""

    name: str
    columns: dict[str, DataType]
    key: tuple[str, ...]
    dates: tuple[str, ...] = ()
    required_dates: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, t) for n, t in self.columns.items()])

    @property
    def read_schema(self) -> StructType:
        decimal = lambda t: READ if isinstance(t, DecimalType) else t
        return StructType([StructField(n, decimal(t)) for n, t in self.columns.items()])

    @property
    def optional_dates(self) -> tuple[str, ...]:
        return tuple(c for c in self.dates if c not in self.required_dates)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.key + self.required_dates))


PRODUCTS = SourceTable(
    "products",
    {
        "tenant_id": _TEXT, "product_id": _TEXT, "product_name": _TEXT, "category": _TEXT,
        "unit_cost": PRICE, "unit_price": PRICE,
        "current_stock": _INT, "reorder_point": _INT, "reorder_quantity": _INT,
    },
    key=("tenant_id", "product_id"),
)
CUSTOMERS = SourceTable(
    "customers",
    {
        "tenant_id": _TEXT, "customer_id": _TEXT, "customer_name": _TEXT, "segment": _TEXT,
        "signup_date": _TEXT, "payment_terms_days": _INT, "chronic_late_payer": _BOOL,
    },
    key=("tenant_id", "customer_id"),
    dates=("signup_date",),
)
SALES = SourceTable(
    "sales_transactions",
    {
        "tenant_id": _TEXT, "transaction_id": _TEXT, "transaction_date": _TEXT,
        "customer_id": _TEXT, "product_id": _TEXT, "quantity": _INT, "unit_price": PRICE,
        "total_amount": MONEY, "payment_method": _TEXT, "channel": _TEXT,
    },
    key=("tenant_id", "transaction_id"),
    dates=("transaction_date",),
    required_dates=("transaction_date",),
)
LEDGER = SourceTable(
    "cash_ledger",
    {
        "tenant_id": _TEXT, "ledger_id": _TEXT, "entry_date": _TEXT, "flow_type": _TEXT,
        "category": _TEXT, "amount": MONEY, "description": _TEXT, "customer_id": _TEXT,
    },
    key=("tenant_id", "ledger_id"),
    dates=("entry_date",),
    required_dates=("entry_date",),
)
POSITION = SourceTable(
    "daily_cash_position",
    {
        "tenant_id": _TEXT, "position_date": _TEXT, "opening_balance": MONEY,
        "total_inflows": MONEY, "total_outflows": MONEY, "closing_balance": MONEY,
    },
    key=("tenant_id", "position_date"),
    dates=("position_date",),
    required_dates=("position_date",),
)

SOURCES = {t.name: t for t in (PRODUCTS, CUSTOMERS, SALES, LEDGER, POSITION)}

FORECAST = StructType([
    StructField("tenant_id", StringType()),
    StructField("forecast_day", IntegerType()),
    StructField("forecast_date", DateType()),
    StructField("predicted_balance", DoubleType()),
    StructField("confidence_lower", DoubleType()),
    StructField("confidence_upper", DoubleType()),
    StructField("risk_flag", BooleanType()),
])

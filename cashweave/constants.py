"""Business thresholds and windows that results depend on."""

RISK_BALANCE = 2000.0  # a balance below this is a cash risk
RUNWAY_ALERT_DAYS = 30  # a runway below this is a cash risk
LATE_DAYS_PAST_TERMS = 15  # mean days past own terms above this: at-risk customer
BURN_ROWS = 30  # trailing daily rows behind the burn rate
HORIZON_DAYS = 90
CHECKPOINT_DAYS = (30, 60, 90)
BAND_Z = 1.645  # width of the confidence band in residual deviations
TRAIN_SHARE = 0.85  # time-ordered share of rows used for training
STARTING_BALANCE = 23000

RETAIL = "retail"
WHOLESALE = "wholesale"
INFLOW = "inflow"
OUTFLOW = "outflow"
INVOICE_PAYMENT = "wholesale_invoice_payment"
LEDGER_CATEGORIES = (
    "retail_sales",
    "wholesale_invoice_payment",
    "inventory_restock",
    "rent",
    "utilities",
    "loan_payment",
    "payroll",
)

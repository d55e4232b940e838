"""Working capital: payment-delay models of receivables and payables, net amount by week."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.functions.columns import (
    PAYMENT_STATES,
    add_days,
    ne_or_null,
    one_hot,
    parse_any_date,
    parse_us_date,
    payment_delay,
    payment_status,
    round_half_even,
    week_of,
)
from ledgerloom.functions.frames import rename
from ledgerloom.operators.aggregates import entity_features, pivot_sums, row_percent, sum_by_week
from ledgerloom.operators.boosting import BoostedTrees, fit_boosted
from ledgerloom.operators.features import hash_split
from ledgerloom.operators.joins import attach_features, net_by_week
from ledgerloom.operators.profile import correlated_columns
from ledgerloom.session import materialize, temporary_tables

# Input column names, and the levels the models are trained with.
RECEIVABLE_NAMES = {
    "Customer Number": "customer_number",
    "Invoice ID": "invoice_id",
    "Posting_Date": "posting_date",
    "Due_Date": "due_date",
    "Baseline_Date": "baseline_date",
    "Payment_Date": "payment_date",
    "Total Open Amount_USD": "amount",
    "Payterm": "payterm",
    "DUNNLEVEL": "dunnlevel",
    "Is Open": "is_open",
    "Credit_limit": "credit_limit",
    "Region": "region",
}
PAYABLE_NAMES = {
    "Supplier ID": "supplier_id",
    "Invoice Number": "invoice_number",
    "Invoice Status": "status",
    "Posting Date": "posting_date",
    "Net Due Date (System Calculated Date)": "due_date",
    "Invoice Date": "invoice_date",
    "Payment Date": "payment_date",
    "Invoice Amount": "amount",
    "Overdue": "overdue",
    "Total Outstanding amount": "outstanding",
    "Late payment fees": "late_fees",
    "Payterm_n": "payterm_n",
    "Spend Category": "spend_category",
    "Vendor_Type": "vendor_type",
}
REGIONS = ["MIDWEST", "NORTHEAST", "SOUTHEAST", "SOUTHWEST", "WEST"]
SPEND_CATEGORIES = ["Fees", "Raw Material", "Services", "Taxes", "Utility"]
VENDOR_TYPES = ["Domestic", "International"]

SHARES = [f"TA_{s}" for s in PAYMENT_STATES]


def _dated(df: DataFrame, cols: list[str], parse) -> DataFrame:
    """Parse text dates; columns that are dates already stay."""
    return df.withColumns(
        {c: parse(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.to_date(c) for c in cols}
    )


def clean_receivables(raw: DataFrame) -> DataFrame:
    """Named, typed receivables. Bad dates and numbers raise; open invoices have no payment date."""
    df = rename(raw, RECEIVABLE_NAMES)
    whole = {c: F.col(c).cast("int") for c in ("payterm", "dunnlevel", "is_open", "credit_limit")}
    df = df.withColumns(whole).withColumn("amount", round_half_even(F.col("amount").cast("double")))
    df = _dated(df, ["posting_date", "due_date", "baseline_date"], parse_us_date)
    paid = F.col("payment_date")
    parsed = parse_us_date(paid) if isinstance(df.schema["payment_date"].dataType, T.StringType) else F.to_date(paid)
    return df.withColumn("payment_date", F.when(F.col("is_open") == 0, parsed))


def clean_payables(raw: DataFrame) -> DataFrame:
    """Named, typed payables; dates of several formats, NULL when none fits."""
    df = rename(raw, PAYABLE_NAMES)
    amounts = ["amount", "overdue", "outstanding", "late_fees"]
    df = df.withColumns({c: round_half_even(F.col(c).cast("double")) for c in amounts})
    df = df.withColumn("payterm_n", F.col("payterm_n").cast("int"))
    return _dated(df, ["posting_date", "due_date", "invoice_date", "payment_date"], parse_any_date)


def with_delay(df: DataFrame) -> DataFrame:
    """Add ``delay`` (due minus paid, in days) and the payment ``state``."""
    delay = payment_delay(F.col("due_date"), F.col("payment_date"))
    return df.withColumn("delay", delay).withColumn("state", payment_status(F.col("delay")))


def customer_features(invoices: DataFrame) -> DataFrame:
    """Per customer: invoice count, mean limit and dunning level, percent of amount by payment state."""
    extra = pivot_sums(F.col("state"), "amount", PAYMENT_STATES, "TA_") if "state" in invoices.columns else []
    features = entity_features(
        invoices,
        "customer_number",
        counts={"inv_count": "invoice_id"},
        means={"credit_limit_mean": "credit_limit", "dunnlevel_mean": "dunnlevel"},
        sums={"amount_total": "amount"},
        extra=extra,
    )
    return row_percent(features, SHARES) if extra else features


def vendor_features(invoices: DataFrame) -> DataFrame:
    """Per supplier: invoice count, mean fees and overdue, percent of amount by payment state."""
    extra = pivot_sums(F.col("state"), "amount", PAYMENT_STATES, "TA_") if "state" in invoices.columns else []
    features = entity_features(
        invoices,
        "supplier_id",
        counts={"inv_count": "invoice_number"},
        means={"late_fees_mean": "late_fees", "overdue_mean": "overdue"},
        sums={"amount_total": "amount"},
        extra=extra,
    )
    return row_percent(features, SHARES) if extra else features


def receivable_rows(clean: DataFrame, is_open: int, regions=REGIONS) -> DataFrame:
    """Open or closed invoices with customer features, region columns and posting gap."""
    rows = clean.where(F.col("is_open") == is_open)
    rows = rows if is_open else with_delay(rows)
    joined = attach_features(rows, customer_features(rows), "customer_number")
    return joined.select(
        "*", *one_hot("region", regions), F.datediff("posting_date", "baseline_date").alias("diff_pb")
    )


def payable_rows(clean: DataFrame, unpaid: bool) -> DataFrame:
    """Unpaid or other invoices with vendor features, category columns and posting gap."""
    if unpaid:
        rows = clean.where(F.col("status") == "Unpaid")
    else:
        rows = with_delay(clean.where(ne_or_null(F.col("status"), "Unpaid")))
    joined = attach_features(rows, vendor_features(rows), "supplier_id")
    return joined.select(
        "*",
        *one_hot("spend_category", SPEND_CATEGORIES, "Spend Category"),
        *one_hot("vendor_type", VENDOR_TYPES, "Vendor_Type"),
        F.datediff("posting_date", "invoice_date").alias("diff_pb"),
    )


def receivable_columns(regions=REGIONS) -> list[str]:
    return ["payterm", "amount", "credit_limit", "credit_limit_mean", *regions, "diff_pb"]


# The order decides which of two correlated columns is dropped.
PAYABLE_COLUMNS = [
    "diff_pb",
    *[f"Spend Category_{v}" for v in SPEND_CATEGORIES],
    "overdue_mean",
    "payterm_n",
    *[f"Vendor_Type_{v}" for v in VENDOR_TYPES],
    "late_fees_mean",
    "inv_count",
    "delay",
    "amount",
]


@dataclass
class DelayFit:
    model: PipelineModel
    features: list[str]
    importances: list[float]
    scores: dict[str, float] = field(default_factory=dict)  # r2 and mse of train and test


def regression_scores(scored: DataFrame) -> tuple[float, float]:
    """(R2, mean squared error) of prediction and label in one pass."""
    error = F.col("label") - F.col("prediction")
    n, square, spread_ = scored.agg(F.count("*"), F.sum(error * error), F.var_pop("label")).first()
    mse = square / n
    return (1 - mse / spread_ if spread_ else float(mse == 0)), mse


def fit_delay(rows: DataFrame, features: list[str], key: str, iterations: int, seed: int) -> DelayFit:
    """Gradient-boosted trees on the delay; NULL counts as 0 in features and target."""
    with temporary_tables():
        return _fit_delay(rows, features, key, iterations, seed)


def _fit_delay(rows: DataFrame, features: list[str], key: str, iterations: int, seed: int) -> DelayFit:
    columns = [f"x{i}" for i in range(len(features))]
    zeros = ", ".join(f"CAST(coalesce(`{c}`, 0) AS DOUBLE) AS {x}" for c, x in zip(features, columns))
    ready = SQLTransformer(statement=f"SELECT *, {zeros} FROM __THIS__")
    label = F.coalesce("delay", F.lit(0)).cast("double").alias("label")
    train, test = hash_split(materialize(ready.transform(rows).select(key, label, *columns), "delay"), key, 0.7, seed)
    trees = fit_boosted(train, columns, rounds=iterations, depth=3, step=0.2)
    predict = BoostedTrees(inputCols=columns, model=trees.to_json())
    fit = DelayFit(PipelineModel(stages=[ready, predict]), features, trees.importances)
    for name, part in (("train", train), ("test", test)):
        fit.scores[f"{name}_r2"], fit.scores[f"{name}_mse"] = regression_scores(predict.transform(part))
    return fit


def fit_receivables(raw: DataFrame, iterations: int = 100, seed: int = 42, regions=REGIONS) -> DelayFit:
    rows = receivable_rows(clean_receivables(raw), 0, regions)
    return fit_delay(rows, receivable_columns(regions), "invoice_id", iterations, seed)


def fit_payables(raw: DataFrame, iterations: int = 100, seed: int = 42, threshold: float = 0.8) -> DelayFit:
    """Columns that repeat an earlier one are dropped here, and the choice stays with the model."""
    with temporary_tables():
        rows = materialize(payable_rows(clean_payables(raw), unpaid=False), "payable-features")
        dropped = correlated_columns(rows, PAYABLE_COLUMNS, threshold, keep=("delay",))
        features = [c for c in PAYABLE_COLUMNS if c not in dropped and c not in ("inv_count", "delay")]
        return fit_delay(rows, features, "invoice_number", iterations, seed)


def with_predicted_week(rows: DataFrame, model: PipelineModel, sign: int = 1) -> DataFrame:
    """Add predicted delay, date and ISO week.

    The delay is due minus paid, so ``sign=-1`` gives the day of payment;
    ``sign=+1`` adds the delay to the due date and is the default for parity.
    """
    scored = model.transform(rows).withColumn("predicted_delay", F.col("prediction"))
    day = add_days(F.col("due_date"), F.lit(sign) * F.col("predicted_delay"))
    return scored.withColumn("predicted_date", day).withColumn("week", week_of(F.col("predicted_date")))


def working_capital(
    receivables: DataFrame,
    payables: DataFrame,
    receivable_model: PipelineModel,
    payable_model: PipelineModel,
    how: str = "inner",
    sign: int = 1,
    with_year: bool = False,
    regions=REGIONS,
    settled: bool = False,
) -> DataFrame:
    """(week, amount_ar, amount_ap, working_capital) of open and unpaid invoices by predicted week.

    ``settled`` gives the same of closed and paid invoices, the rows that the
    models were trained and tested with.
    """
    ar = with_predicted_week(receivable_rows(clean_receivables(receivables), int(not settled), regions), receivable_model, sign)
    ap = with_predicted_week(payable_rows(clean_payables(payables), not settled), payable_model, sign)
    keys = ("iso_year", "week") if with_year else ("week",)
    return net_by_week(
        sum_by_week(ar, "predicted_date", "amount", "amount_ar", with_year),
        sum_by_week(ap, "predicted_date", "amount", "amount_ap", with_year),
        keys,
        how,
    )

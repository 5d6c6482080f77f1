"""Fixed schemas of the ledger's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

MONEY = "money"
_TYPES = {"string": StringType(), "date": DateType(), MONEY: DecimalType(18, 2), "timestamp": TimestampType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}

_DDL = {
    "transactions": f"user_id string, bank string, account_id string, account_last4 string, date date, description string, amount {MONEY}, currency string, source_file_sha256 string, ingested_at timestamp",
    "statements": f"user_id string, bank string, account_id string, account_last4 string, period_start date, period_end date, opening_balance {MONEY}, closing_balance {MONEY}, declared_charges_total {MONEY}, declared_credits_total {MONEY}, account_kind string, currency string, file_sha256 string, ingested_at timestamp",
    "investment_entries": f"user_id string, place string, currency string, entry_date date, kind string, amount {MONEY}, balance {MONEY}, detail string, sheet_row int, month_key string, ingested_at timestamp",
    "ingested_files": "user_id string, file_sha256 string, ingested_at timestamp",
    "category_labels": "user_id string, bank string, description string, category string, is_trusted boolean, ingested_at timestamp",
    "category_predictions": "user_id string, bank string, description string, category string, predicted_at timestamp",
    "plan_fixed_items": f"user_id string, bank string, description string, currency string, category string, months_seen int, typical_amount {MONEY}, proposed_kind string, kind string, expected_amount {MONEY}, note string, loaded_at timestamp",
    "plan_goal": f"user_id string, goal_amount {MONEY}, goal_currency string, usd_to_pen double, emergency_months int, emergency_basis string, emergency_account string, target_date date, income_pen_override {MONEY}, income_usd_override {MONEY}, loaded_at timestamp",
    "spend_forecasts": f"user_id string, run_month date, kind string, category string, currency string, target_month date, horizon int, model_name string, p10 {MONEY}, p50 {MONEY}, p90 {MONEY}, actual {MONEY}, created_at timestamp",
    "spend_forecast_series": "user_id string, run_month date, category string, currency string, model_name string, baseline_used boolean, low_history boolean, n_months int, n_origins int, mae_rel double, coverage double, created_at timestamp",
    "goal_cashflow": f"user_id string, run_month date, scenario string, month_index int, month date, currency string, income {MONEY}, fixed {MONEY}, variable {MONEY}, created_at timestamp",
    "goal_balances": f"user_id string, run_month date, bucket string, currency string, amount {MONEY}, created_at timestamp",
}



def _struct(columns: str) -> StructType:
    """'name type, ...' without a session, which the DDL parser would need."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in columns.split(","))])


SCHEMAS: dict[str, StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

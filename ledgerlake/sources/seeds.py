"""Static dimensions and a deterministic demo lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The spending categories and what they hold.
CATEGORIES = (
    ("Servicios", "Utilities, subscriptions and bank fees"),
    ("Restaurantes", "Restaurants, delivery and takeout"),
    ("Alimentacion", "Supermarkets and grocery stores"),
    ("Viajes", "Airfare, lodging and travel agencies"),
    ("Transporte", "Ride-hailing, fuel and public transport"),
    ("Deporte", "Gyms and sports clubs"),
    ("Ingresos", "Salary and other income"),
    ("Transferencias", "Transfers to someone else's account"),
    ("Entretenimiento", "Leisure, events and outings"),
    ("Salud", "Pharmacies, clinics and health insurance"),
    ("Ahorros", "Money set aside for saving"),
    ("Cuidado Personal", "Hairdresser, grooming and personal care"),
    ("Ropa", "Clothing and footwear"),
    ("Educacion", "Tuition, courses and learning"),
    ("Gastos varios", "Anything that does not fit another category"),
)


def category_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES), "category string, description string")


def demo_movements(spark: SparkSession, first_open_month: str, months: int = 8, users: int = 1) -> DataFrame:
    """Movements of closed months before the given one: pay, rent, food and a card payment per user
    and month, on an asset and a liability account in PEN and an asset account in USD."""
    first = F.trunc(F.lit(first_open_month).cast("date"), "MM")
    grid = spark.range(users).select(F.concat(F.lit("demo"), F.col("id").cast("string")).alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(months))).alias("k")).withColumn("month", F.add_months(first, -F.col("k")))
    one = lambda day, account, kind, currency, text, cents: F.struct(F.date_add("month", day - 1).alias("date"), F.lit(account).alias("account_id"), F.lit(kind).alias("account_kind"), F.lit(currency).alias("currency"), F.lit(text).alias("description"), cents.cast("long").alias("cents"))
    k = F.col("k")
    rows = F.array(
        one(1, "checking", "asset", "PEN", "PLANILLA", F.lit(500000)),
        one(2, "checking", "asset", "PEN", "ALQUILER", F.lit(-150000)),
        one(5, "card", "liability", "PEN", "SUPERMERCADO", 20000 + 1000 * k),
        one(20, "card", "liability", "PEN", "PAGO TARJETA", -(20000 + 1000 * k)),
        one(20, "checking", "asset", "PEN", "PAGO TARJETA", -(20000 + 1000 * k)),
        one(15, "dollars", "asset", "USD", "HONORARIOS", 30000 + 500 * k),
    )
    return grid.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.*")

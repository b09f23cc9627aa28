"""Star schema built from a raw sales table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from ledgerlake.functions import values as v
from ledgerlake.functions.dates import date_key, day_of
from ledgerlake.operators.ranking import ntile_scores, number_by_lead
from ledgerlake.operators.upsert import insert_absent, one_per_key, upsert
from ledgerlake.plans.schema import TABLE_ROLES, Warehouse, require_sales_columns
from ledgerlake.staging import join_side, new_path, stage, stage_at, together

GEOGRAPHY = ["city", "state", "region", "country"]
PRODUCT = ["product_name", "category", "sub_category"]
# Facts that agree in all of these are equal, so any order among them will do.
FACT_ORDER = [
    "date_key", "order_id", "customer_key", "product_key", "geo_key", "sales", "quantity", "discount", "profit",
]
_EXACT = "decimal(18,4)"
# A customer may hold any share of the rows, so totals get room to grow.
_TOTAL = "decimal(28,2)"


def product_rows(raw: DataFrame) -> DataFrame:
    """One row per product of the raw rows."""
    return one_per_key(raw.filter(F.col("product_id").isNotNull()), ["product_id"], PRODUCT)


def products(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    dim = upsert(existing, product_rows(raw), "product_id", PRODUCT, "product_key")
    return dim.select("product_key", "product_id", *PRODUCT)


def place_rows(raw: DataFrame) -> DataFrame:
    """The places of the raw rows."""
    return raw.filter(F.col("city").isNotNull() & F.col("state").isNotNull()).select(*GEOGRAPHY).distinct()


def geography(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return insert_absent(existing, place_rows(raw), GEOGRAPHY, "geo_key").select("geo_key", *GEOGRAPHY)


def calendar(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    days = raw.select(day_of(raw, "order_date").alias("full_date")).distinct()
    incoming = days.filter(F.col("full_date").isNotNull()).select(
        date_key(F.col("full_date")).alias("date_key"),
        "full_date",
        F.year("full_date").alias("year"),
        F.quarter("full_date").alias("quarter"),
        F.month("full_date").alias("month"),
        F.dayofmonth("full_date").alias("day"),
    )
    return insert_absent(existing, incoming, ["date_key"], None)


def customer_activity(raw: DataFrame) -> DataFrame:
    """(customer_id, recency, frequency, monetary) over the rows with a valid date."""
    dated = raw.select(
        "customer_id",
        "order_id",
        v.zero_if_null(F.col("sales").cast(_EXACT)).alias("sales"),
        day_of(raw, "order_date").alias("day"),
    ).filter(F.col("day").isNotNull())
    # Rows without a customer count towards the latest day only. The distinct
    # count groups by (customer, order) first, so a customer holding a large
    # share of the rows is spread over tasks by order.
    totals = stage(
        dated.groupBy("customer_id").agg(
            F.max("day").alias("last_day"),
            F.countDistinct("order_id").alias("frequency"),
            F.sum("sales").cast(_TOTAL).alias("monetary"),
        ),
        "activity",
    )
    latest = totals.agg(F.max("last_day").alias("day")).first()["day"]
    reference_day = F.lit(latest) if latest else F.current_date()
    return join_side(totals).filter(F.col("customer_id").isNotNull()).select(
        "customer_id",
        F.date_diff(reference_day, F.col("last_day")).alias("recency"),
        "frequency",
        "monetary",
    )


def rfm_scores(activity: DataFrame) -> DataFrame:
    """Adds r_score, f_score, m_score (fifths, 5 best), their sum and the tier."""
    scored = ntile_scores(
        activity,
        "customer_id",
        {"r_score": -F.col("recency"), "f_score": F.col("frequency"), "m_score": F.col("monetary")},
    ).withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
    return scored.withColumn("customer_tier", v.customer_tier(F.col("rfm_score")))


def customers(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Customers with their recency, frequency, value, score and tier.

    Customers without a dated row keep what is stored, or the defaults when new.
    """
    attributes = ["customer_name", "segment"]
    incoming = one_per_key(raw.filter(F.col("customer_id").isNotNull()), ["customer_id"], attributes)
    dim = upsert(existing, incoming, "customer_id", attributes, "customer_key")
    scores = rfm_scores(customer_activity(raw)).select(
        "customer_id",
        F.struct(
            F.col("recency").alias("recency_days"),
            "frequency",
            F.col("monetary").alias("monetary_value"),
            "rfm_score",
            "customer_tier",
        ).alias("_now"),
    )
    defaults = {
        "recency_days": F.lit(0),
        "frequency": F.lit(0).cast("bigint"),
        "monetary_value": F.lit(0).cast(_TOTAL),
        "rfm_score": F.lit(0),
        "customer_tier": F.lit("Standard"),
    }
    return dim.join(scores, "customer_id", "left").select(
        "customer_key",
        "customer_id",
        *attributes,
        *[
            F.coalesce(F.col(f"_now.{c}"), F.col(c) if c in dim.columns else default, default).alias(c)
            for c, default in defaults.items()
        ],
    )


def facts(raw: DataFrame, dim_customers: DataFrame, dim_products: DataFrame, dim_geography: DataFrame) -> DataFrame:
    """Dated raw rows with their dimension keys and typed measures.

    The dimensions are written tables, so their sizes are known and one is
    broadcast only below the session's threshold and of no more rows than the
    driver can hold; else the join shuffles and adaptive execution splits a
    customer or product that holds a large share of the rows. Places come first and values get their
    types before, so that what the other joins shuffle is narrow. Keys are places
    in the order of all other columns, so they do not depend on how the rows are
    partitioned; they come from counts per day, without a sort of the whole
    table. The joined rows are written, since they are counted before they are
    numbered.
    """
    dim_customers, dim_products, dim_geography = (join_side(d) for d in (dim_customers, dim_products, dim_geography))
    dated = raw.withColumn("_day", day_of(raw, "order_date"))
    narrow = (
        dated.filter(F.col("_day").isNotNull())
        .join(dim_geography, GEOGRAPHY)
        .select(
            "order_id",
            "customer_id",
            "product_id",
            "geo_key",
            date_key(F.col("_day")).alias("date_key"),
            v.money(F.col("sales")).alias("sales"),
            v.whole(F.col("quantity")).alias("quantity"),
            v.rate(F.col("discount")).alias("discount"),
            v.money(F.col("profit")).alias("profit"),
        )
    )
    lines = (
        narrow.join(dim_products.select("product_id", "product_key"), "product_id")
        .join(dim_customers.select("customer_id", "customer_key"), "customer_id")
        .select("order_id", "customer_key", "product_key", "geo_key", "date_key", "sales", "quantity", "discount", "profit")
    )
    return number_by_lead(stage(lines, "keyed-lines"), FACT_ORDER, "fact_key").select("fact_key", *lines.columns)


def unplaced_rows(raw: DataFrame) -> DataFrame:
    """One row: dated raw rows that cannot reach the fact table, by the key they lack."""
    lacks_place = F.lit(False)
    for c in GEOGRAPHY:
        lacks_place = lacks_place | F.col(c).isNull()
    dated = raw.filter(day_of(raw, "order_date").isNotNull())
    return dated.agg(
        F.count(F.lit(1)).alias("dated_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("no_customer"),
        F.count_if(F.col("product_id").isNull()).alias("no_product"),
        F.count_if(lacks_place).alias("no_place"),
    )


DIMENSIONS = {"dim_products": products, "dim_geography": geography, "dim_time": calendar, "dim_customers": customers}


def build_dimensions(raw: DataFrame, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    require_sales_columns(raw)
    stored = existing or {}
    return {name: make(raw, stored.get(name)) for name, make in DIMENSIONS.items()}


def build_warehouse(raw: DataFrame, existing: dict[str, DataFrame] | None = None) -> Warehouse:
    """All five tables, written as they are built. Dimensions accumulate, facts are rebuilt."""
    require_sales_columns(raw)
    folder, stored = new_path(raw.sparkSession, "warehouse"), existing or {}
    paths = {name: f"{folder}/{name}" for name in TABLE_ROLES}

    def built(name: str) -> DataFrame:
        return stage_at(DIMENSIONS[name](raw, stored.get(name)), paths[name], "zstd")

    dims = dict(zip(DIMENSIONS, together(raw.sparkSession, *[partial(built, name) for name in DIMENSIONS])))
    fact = facts(raw, dims["dim_customers"], dims["dim_products"], dims["dim_geography"])
    sides = {name: join_side(dim) for name, dim in dims.items()}
    return Warehouse(**sides, fact_sales=stage_at(fact, paths["fact_sales"], "zstd"), paths=paths)

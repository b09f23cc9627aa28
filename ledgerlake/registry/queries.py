"""Every operator as a query over the test tables. Dates and decimals leave as text and double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.errors import LedgerLakeError
from ledgerlake.functions import values as v
from ledgerlake.functions.dates import RECOVERING_FORMATS, is_iso_date
from ledgerlake.functions.names import normalise_headers
from ledgerlake.operators import cleaning, classify, quality, timeseries
from ledgerlake.operators.cleaning import Rule
from ledgerlake.operators.duplicates import duplicate_rows
from ledgerlake.operators.isolation import detect_anomalies
from ledgerlake.operators.profile import Profile
from ledgerlake.operators.ranking import global_row_number
from ledgerlake.plans import dashboard, insights, report, sqlstudio, warehouse
from ledgerlake.plans.etl import Lake
from ledgerlake.registry.data import Folder, folder, write_workbook
from ledgerlake.sources import files
from ledgerlake.sources.tables import TableStore
from ledgerlake.sources.workbook import POSITION
from ledgerlake.staging import new_path, stage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# A day that splits the sales into an earlier and a later load.
LOAD_DAY = "1998-01-01"


def query(function: Callable[[Folder], DataFrame]) -> Callable[[Folder], DataFrame]:
    """Register a query under its function's name."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        return function(folder(spark, path))

    _QUERIES[function.__name__] = run
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Sources and sinks


@query
def dataset_listing(f: Folder) -> DataFrame:
    """Rows of all listed files, and how many files with rows were not listed."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    lines = f.spark.read.text(f.csv).groupBy(name.alias("filename")).agg((F.count(F.lit(1)) - 1).alias("rows"))
    listed = files.list_datasets(f.spark, f.csv).withColumn("listed", F.lit(1))
    return lines.join(listed, "filename", "left").agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("listed").isNull() & (F.col("rows") > 0)).alias("unlisted")
    )


@query
def csv_import(f: Folder) -> DataFrame:
    """Delimiter found, headers normalised, types inferred; totals per category."""
    rows = normalise_headers(files.read_delimited(f.spark, f.csv))
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("order_date").alias("dates"),
        F.count("region").alias("regions"),
        F.sum(F.col("sales").cast("decimal(18,4)")).cast("double").alias("sales"),
        F.sum(F.col("profit").cast("decimal(18,4)")).cast("double").alias("profit"),
        F.sum("quantity").cast("bigint").alias("quantity"),
    )


@query
def lowered_columns(f: Folder) -> DataFrame:
    """Upper-case columns of a stored table, lower-cased where it lies."""
    lake = Lake(f.spark, new_path(f.spark, "casing"))
    lake.raw.replace("sales", f.dirty.toDF(*[c.upper() if c != POSITION else c for c in f.dirty.columns]))
    lake.normalise_casing("sales")
    rows = lake.raw.scan("sales")
    names = F.lit(",".join(rows.columns)).alias("columns")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").cast("bigint").alias("quantity")).select("*", names)


@query
def imported_files(f: Folder) -> DataFrame:
    """One file per region, imported under the table name that its file name gives."""
    root, found = new_path(f.spark, "regions"), None
    regions = [r["region"] for r in f.star.dim_geography.select("region").distinct().orderBy("region").collect()]
    for region in regions:
        path = f"{root}/Sales {region.title()}-2024.v1.csv"
        f.clean.filter(F.col("region") == region).select("order_id", F.col("sales").alias("Sales.Total")).write.option("header", True).csv(path)
        got = files.import_file(f.spark, path)
        row = got.rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("sales_total"), 2).alias("sales"))
        row = row.select(F.lit(got.table).alias("table"), F.lit(got.col_count).alias("columns"), "*")
        found = row if found is None else found.unionByName(row)
    return found


@query
def imported_workbook(f: Folder) -> DataFrame:
    """The nations as an .xlsx workbook, read back."""
    nations = f.spark.read.parquet(f"{f.folder}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey")
    path = write_workbook(f.spark, new_path(f.spark, "books"), "Nations.xlsx", nations)
    return files.import_file(f.spark, path).rows.drop(POSITION)


@query
def data_guards(f: Folder) -> DataFrame:
    """What refuses to work on too little of the data, and how."""
    few = f.star.dim_customers.orderBy("customer_key").limit(19)
    path = new_path(f.spark, "empty") + ".csv"
    f.clean.limit(0).coalesce(1).write.option("header", True).csv(path)
    tries = {
        "import": lambda: files.import_file(f.spark, path),
        "profile": lambda: Profile(f.dirty.limit(0)).require_rows(),
        "forecast": lambda: timeseries.fit_sales_model(f.monthly.orderBy("year", "month").limit(11)),
        "lags": lambda: timeseries.fit_sales_model(f.monthly.orderBy("year", "month").limit(17)),
        "classifier": lambda: classify.fit_customer_model(few, f.star.fact_sales),
        "one class": lambda: classify.fit_customer_model(f.star.dim_customers.withColumn("customer_tier", F.lit("Gold")), f.star.fact_sales),
        "anomalies": lambda: detect_anomalies(f.star.fact_sales.orderBy("fact_key").limit(49), f.star.dim_products),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
            rows.append((name, "done"))
        except LedgerLakeError as problem:
            rows.append((name, type(problem).__name__))
    return f.spark.createDataFrame(rows, "guard string, outcome string")


@query
def csv_schema_report(f: Folder) -> DataFrame:
    return files.schema_report(normalise_headers(files.read_delimited(f.spark, f.csv)))


@query
def csv_export(f: Folder) -> DataFrame:
    """A result written as quoted CSV and read back as it stands."""
    path = new_path(f.spark, "export")
    files.export_csv(v.presentable(f.star.dim_products), path)
    return f.spark.read.option("header", True).option("escape", "\\").csv(path)


@query
def table_scan(f: Folder) -> DataFrame:
    rows = f.lake.raw.scan(" Sales; ")
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("quantity").cast("bigint")).alias("quantity")
    )


@query
def etl_run_steps(f: Folder) -> DataFrame:
    steps = f.lake.audit.runs().select(F.col("status").alias("run_status"), F.inline("steps_completed"))
    return steps.select("run_status", "step", "status", F.get("logs", F.lit(0)).alias("first_line"))


@query
def cleaning_history(f: Folder) -> DataFrame:
    rules = f.lake.audit.history("sales").select(F.inline("operations"))
    return rules.withColumn("method", F.col("parameters")["method"]).drop("parameters")


@query
def warehouse_summary(f: Folder) -> DataFrame:
    return dashboard.summary(f.spark, f.star.tables())


@query
def dirty_rows(f: Folder) -> DataFrame:
    return f.dirty


# Warehouse


@query
def date_validity(f: Folder) -> DataFrame:
    return f.dirty.groupBy(is_iso_date(F.col("order_date")).alias("is_valid")).agg(F.count(F.lit(1)).alias("rows"))


@query
def dim_products(f: Folder) -> DataFrame:
    return f.star.dim_products


@query
def dim_geography(f: Folder) -> DataFrame:
    return f.star.dim_geography


@query
def dim_time(f: Folder) -> DataFrame:
    return v.presentable(f.star.dim_time)


@query
def dim_customers(f: Folder) -> DataFrame:
    return v.presentable(f.star.dim_customers)


@query
def fact_sales(f: Folder) -> DataFrame:
    return v.presentable(f.star.fact_sales)


def _loads(f: Folder) -> tuple[DataFrame, DataFrame]:
    return f.clean.filter(F.col("order_date") < LOAD_DAY), f.clean.filter(F.col("order_date") >= LOAD_DAY)


@query
def products_after_second_load(f: Folder) -> DataFrame:
    """Keys of the first load stay, attributes come from the second."""
    early, late = _loads(f)
    first = stage(warehouse.products(early.withColumn("product_name", F.lit("old"))), "first-load")
    return warehouse.products(late, first)


@query
def products_merged_by_range(f: Folder) -> DataFrame:
    """The same, kept in files by key range of which the second load rewrites what it touches."""
    early, late = _loads(f)
    store = TableStore(f.spark, new_path(f.spark, "ranged"), "warehouse")
    for rows in (early.withColumn("product_name", F.lit("old")), late):
        store.merge("dim_products", warehouse.product_rows(rows), ["product_id"], warehouse.PRODUCT, "product_key", 50)
    return store.scan("dim_products").select("product_key", "product_id", *warehouse.PRODUCT)


@query
def geography_after_second_load(f: Folder) -> DataFrame:
    """Rows with an unknown region are one place, however often they are loaded."""
    raw = f.dirty.select(*warehouse.GEOGRAPHY)
    first = stage(warehouse.geography(raw.filter(F.col("region").isNull())), "first-load")
    return warehouse.geography(raw, first)


@query
def calendar_after_second_load(f: Folder) -> DataFrame:
    early, late = _loads(f)
    return v.presentable(warehouse.calendar(late, stage(warehouse.calendar(early), "first-load")))


@query
def customers_after_second_load(f: Folder) -> DataFrame:
    """Customers without sales in the second load keep the scores of the first."""
    early, late = _loads(f)
    first = stage(warehouse.customers(early), "first-load")
    return v.presentable(warehouse.customers(late, first))


@query
def facts_of_dirty_rows(f: Folder) -> DataFrame:
    """Facts straight from the dirty rows: bad dates and unknown places drop out."""
    raw = f.dirty.drop(POSITION)
    dims = [stage(d(raw), "dim") for d in (warehouse.customers, warehouse.products, warehouse.geography)]
    return warehouse.facts(raw, *dims).groupBy("date_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("sales").cast("double").alias("sales"),
        F.sum("quantity").alias("quantity"),
        F.sum("discount").cast("double").alias("discount"),
        F.sum("profit").cast("double").alias("profit"),
    )


@query
def unplaced_rows(f: Folder) -> DataFrame:
    return warehouse.unplaced_rows(f.dirty)


@query
def customer_activity(f: Folder) -> DataFrame:
    return v.presentable(warehouse.customer_activity(f.clean))


@query
def rfm_scores(f: Folder) -> DataFrame:
    return v.presentable(warehouse.rfm_scores(warehouse.customer_activity(f.clean)))


@query
def customers_after_run(f: Folder) -> DataFrame:
    """Customers of the warehouse built by a full run over the dirty rows."""
    return v.presentable(f.lake.star.scan("dim_customers"))


@query
def sales_after_run(f: Folder) -> DataFrame:
    return dashboard.category_performance(f.lake.warehouse())


# Dashboard


@query
def dashboard_kpis(f: Folder) -> DataFrame:
    return dashboard.kpis(f.star.fact_sales)


@query
def monthly_trend(f: Folder) -> DataFrame:
    return dashboard.monthly_trend(f.star)


@query
def category_performance(f: Folder) -> DataFrame:
    return dashboard.category_performance(f.star)


@query
def region_performance(f: Folder) -> DataFrame:
    return dashboard.region_performance(f.star)


@query
def region_share(f: Folder) -> DataFrame:
    return dashboard.region_share(f.star)


@query
def top_products(f: Folder) -> DataFrame:
    return dashboard.top_products(f.star)


@query
def top_cities(f: Folder) -> DataFrame:
    return dashboard.top_cities(f.star)


@query
def average_discount(f: Folder) -> DataFrame:
    return dashboard.average_discount(f.star.fact_sales)


@query
def top_segment(f: Folder) -> DataFrame:
    return dashboard.top_segment(f.star)


@query
def top_region(f: Folder) -> DataFrame:
    return dashboard.top_region(f.star)


@query
def unprofitable_categories(f: Folder) -> DataFrame:
    return dashboard.unprofitable_categories(f.star)


@query
def high_value_customers(f: Folder) -> DataFrame:
    return dashboard.high_value_customers(f.star)


@query
def recent_months(f: Folder) -> DataFrame:
    return dashboard.recent_months(f.star)


@query
def product_labels(f: Folder) -> DataFrame:
    name = F.col("product_name")
    return f.star.dim_products.select("product_id", v.short_name(name).alias("label"), v.short_name(name, 8).alias("short"))


# Profile and quality


@query
def table_shape(f: Folder) -> DataFrame:
    return report.profile_section(f.profile)


@query
def duplicate_count(f: Folder) -> DataFrame:
    return duplicate_rows(f.profile.source)


@query
def null_profile(f: Folder) -> DataFrame:
    return f.profile.null_counts()


@query
def numeric_profile(f: Folder) -> DataFrame:
    return f.profile.numeric_summary()


@query
def outlier_profile(f: Folder) -> DataFrame:
    return f.profile.outliers().withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)})


@query
def histograms(f: Folder) -> DataFrame:
    """As the dashboard shows them: rows at the maximum are left out."""
    return f.profile.histograms(include_max=False)


@query
def histograms_with_maximum(f: Folder) -> DataFrame:
    return f.profile.histograms()


@query
def correlations(f: Folder) -> DataFrame:
    return f.profile.correlations().withColumn("correlation", F.round("correlation", 8))


@query
def column_profile(f: Folder) -> DataFrame:
    return f.profile.columns()


@query
def quality_scores(f: Folder) -> DataFrame:
    return quality.quality_scores(f.profile)


@query
def recovered_consistency(f: Folder) -> DataFrame:
    """Share of dates that parse when all known formats are accepted."""
    return quality.consistency(f.profile, RECOVERING_FORMATS)


# Dates in other forms


def _dated(f: Folder, order_date) -> DataFrame:
    """Clean sales with dates in another form, standardised, and summed per day in the fact table."""
    raw = f.clean.withColumn("order_date", order_date).withColumn(POSITION, F.monotonically_increasing_id())
    rows, _ = cleaning.apply_rules(raw, [Rule("standardize_dates", "order_date")], POSITION)
    facts = warehouse.facts(rows.drop(POSITION), f.star.dim_customers, f.star.dim_products, f.star.dim_geography)
    return facts.groupBy("date_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("sales").cast("double").alias("sales"))


@query
def us_dates(f: Folder) -> DataFrame:
    return _dated(f, F.date_format(F.col("order_date").cast("date"), "M/d/yyyy"))


@query
def day_first_dates(f: Folder) -> DataFrame:
    return _dated(f, F.date_format(F.col("order_date").cast("date"), "dd/MM/yyyy"))


@query
def datetime_texts(f: Folder) -> DataFrame:
    by_seven = F.dayofmonth(F.col("order_date").cast("date")) % 7 == 0
    return _dated(f, F.concat("order_date", F.when(by_seven, "T08:30:00Z").otherwise(" 00:00:00")))


@query
def typed_dates(f: Folder) -> DataFrame:
    return _dated(f, F.col("order_date").cast("timestamp"))


@query
def sku_import(f: Folder) -> DataFrame:
    """Codes that a cast would take for numbers stay text."""
    path = new_path(f.spark, "skus")
    f.star.dim_products.select(F.concat("product_id", F.lit("D")).alias("sku"), F.concat("product_id", F.lit(".5e1")).alias("n")).write.option("header", True).csv(path)
    rows = files.read_delimited(f.spark, path)
    kinds = [F.lit(dict(rows.dtypes)[c]).alias(f"{c}_type") for c in ("sku", "n")]
    return rows.agg(*kinds, F.count(F.lit(1)).alias("rows"), F.max("sku").alias("last_sku"), F.sum("n").alias("total"))


@query
def float_profile(f: Folder) -> DataFrame:
    """A FLOAT column with NaN: NaN is missing, and every value has its place in the histogram."""
    lines = f.spark.read.parquet(f"{f.folder}/lineitem.parquet")
    value = F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).cast("float")
    profile = Profile(lines.select(value.alias("value")))
    counted = profile.histograms().groupBy("column").agg(F.sum("count").alias("counted"))
    summary = profile.null_counts().join(profile.numeric_summary(), "column").join(counted, "column")
    return summary.select("null_count", "unique_count", "counted", F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"))


def _mixed_dates(f: Folder) -> DataFrame:
    """Order dates with the month first, some with the day first or two digits of the year, some missing or no dates."""
    day = F.col("order_date").cast("date")
    text = (
        F.when(F.col(POSITION) % 31 == 7, F.lit(None))
        .when(F.col(POSITION) % 31 == 8, "unknown")
        .when((F.col(POSITION) % 5 == 2) & (F.dayofmonth(day) > 12), F.date_format(day, "dd/MM/yyyy"))
        .when(F.col(POSITION) % 7 == 3, F.date_format(day, "M/d/yy"))
        .otherwise(F.date_format(day, "M/d/yyyy"))
    )
    return f.dirty.filter(is_iso_date(F.col("order_date"))).withColumn("order_date", text)


@query
def mixed_dates(f: Folder) -> DataFrame:
    """What cannot be read stays as it is; only rows without a date take a neighbour's."""
    rule = Rule("standardize_dates", "order_date", parameters={"unread": "keep"})
    rows, _ = cleaning.apply_rules(_mixed_dates(f), [rule], POSITION)
    return rows.select(POSITION, "order_date")


@query
def mixed_consistency(f: Folder) -> DataFrame:
    """The share of dates that cleaning would read."""
    return quality.consistency(Profile(_mixed_dates(f).drop(POSITION)), None)


# Cleaning


@query
def recommended_rules(f: Folder) -> DataFrame:
    rules = cleaning.recommend_rules(f.profile)
    return rules.withColumn("method", F.col("parameters")["method"]).drop("parameters")


@query
def rows_without_duplicates(f: Folder) -> DataFrame:
    return cleaning.keep_first(f.dirty, POSITION)


def _fill(f: Folder, column: str, method: str) -> DataFrame:
    rows, _ = cleaning.apply_rules(
        f.dirty, [Rule("fill_nulls", column, parameters={"method": method})], POSITION
    )
    return rows.select(POSITION, column)


@query
def filled_with_mean(f: Folder) -> DataFrame:
    return _fill(f, "sales", "mean").withColumn("sales", F.round("sales", 4))


@query
def filled_with_median(f: Folder) -> DataFrame:
    return _fill(f, "profit", "median").withColumn("profit", F.round("profit", 4))


@query
def filled_with_mode(f: Folder) -> DataFrame:
    return _fill(f, "segment", "mode")


@query
def standard_dates(f: Folder) -> DataFrame:
    """Known formats rewritten; only impossible dates take a neighbour's."""
    rows, _ = cleaning.apply_rules(f.dirty, [Rule("standardize_dates", "order_date")], POSITION)
    return rows.select(POSITION, "order_date")


@query
def standard_dates_strict(f: Folder) -> DataFrame:
    """Every date not written as yyyy-MM-dd takes a neighbour's."""
    rows, _ = cleaning.apply_rules(
        f.dirty, [Rule("standardize_dates", "order_date")], POSITION, ("yyyy-MM-dd",)
    )
    return rows.select(POSITION, "order_date")


@query
def cleaned_rows(f: Folder) -> DataFrame:
    return f.cleaned.withColumns({c: F.round(c, 4) for c in ("sales", "profit")})


@query
def cleaning_preview(f: Folder) -> DataFrame:
    return cleaning.preview(f.cleaned, POSITION).withColumns({c: F.round(c, 4) for c in ("sales", "profit")})


# Ad-hoc SQL


def _sql(f: Folder, text: str) -> DataFrame:
    sqlstudio.register(f.spark, f.star)
    return v.presentable(sqlstudio.query(f.spark, text))


@query
def saved_high_value_customers(f: Folder) -> DataFrame:
    return _sql(f, sqlstudio.SAVED_QUERIES["Get High-Value Customers"])


@query
def saved_revenue_by_category(f: Folder) -> DataFrame:
    return _sql(f, sqlstudio.SAVED_QUERIES["Revenue by Product Category"])


@query
def saved_top_cities(f: Folder) -> DataFrame:
    return _sql(f, sqlstudio.SAVED_QUERIES["Top Cities by Sales Volume"])


@query
def sql_capped_rows(f: Folder) -> DataFrame:
    """A WITH query whose result is longer than the cap."""
    return _sql(
        f,
        """
        WITH days AS (
            SELECT t.full_date, SUM(f.sales) AS sales
            FROM warehouse.fact_sales f JOIN warehouse.dim_time t ON f.date_key = t.date_key
            GROUP BY t.full_date
        )
        SELECT full_date, sales FROM days ORDER BY full_date;""",
    )


@query
def sql_in_subquery(f: Folder) -> DataFrame:
    return _sql(
        f,
        """
        SELECT d.year, COUNT(*) AS n_facts, SUM(s.sales) AS sales
        FROM warehouse.fact_sales s JOIN warehouse.dim_time d ON d.date_key = s.date_key
        WHERE s.customer_key IN (SELECT customer_key FROM warehouse.dim_customers WHERE customer_tier = 'Platinum')
          AND s.product_key NOT IN (SELECT product_key FROM warehouse.dim_products WHERE product_key % 2 = 0)
        GROUP BY d.year""",
    )


@query
def sql_exists(f: Folder) -> DataFrame:
    return _sql(
        f,
        """
        SELECT g.region, COUNT(*) AS places
        FROM warehouse.dim_geography g
        WHERE EXISTS (SELECT 1 FROM warehouse.fact_sales s WHERE s.geo_key = g.geo_key AND s.discount > 0.09)
        GROUP BY g.region""",
    )


@query
def sql_scalar_subquery(f: Folder) -> DataFrame:
    return _sql(
        f,
        """
        SELECT p.category, COUNT(*) AS above_average
        FROM warehouse.fact_sales s JOIN warehouse.dim_products p ON p.product_key = s.product_key
        WHERE s.sales > (SELECT AVG(sales) FROM warehouse.fact_sales)
          AND s.quantity = (SELECT MAX(i.quantity) FROM warehouse.fact_sales i WHERE i.order_id = s.order_id)
        GROUP BY p.category""",
    )


@query
def sql_lateral(f: Folder) -> DataFrame:
    return _sql(
        f,
        """
        SELECT t.year, t.month, x.n_facts, x.sales
        FROM (SELECT year, month, MIN(date_key) AS low, MAX(date_key) AS high FROM warehouse.dim_time GROUP BY year, month) t,
        LATERAL (SELECT COUNT(*) AS n_facts, SUM(s.sales) AS sales FROM warehouse.fact_sales s
                 JOIN warehouse.dim_time d ON d.date_key = s.date_key WHERE d.year = t.year AND d.month = t.month) x""",
    )


# Forecast


@query
def month_series(f: Folder) -> DataFrame:
    return v.presentable(timeseries.continuous_months(f.monthly))


@query
def lag_features(f: Folder) -> DataFrame:
    return v.presentable(timeseries.lag_features(timeseries.continuous_months(f.monthly)))


@query
def forecast_split(f: Folder) -> DataFrame:
    features = timeseries.lag_features(timeseries.continuous_months(f.monthly))
    return v.presentable(timeseries.ordered_split(features).select("month", "is_test"))


@query
def forecast_coefficients(f: Folder) -> DataFrame:
    return f.sales_model.coefficient_table()


@query
def forecast_metrics(f: Folder) -> DataFrame:
    return f.sales_model.metrics()


@query
def sales_forecast(f: Folder) -> DataFrame:
    return v.presentable(f.sales_model.forecast())


def _two_places(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


@query
def category_coefficients(f: Folder) -> DataFrame:
    """A ridge model for every category with enough months."""
    fitted = f.category_forecast.coefficients
    lags = {c: F.round(c, 6) for c in fitted.columns if c.startswith("b_lag")}
    return _two_places(fitted, "intercept", "b_month_num").withColumns(lags)


@query
def category_metrics(f: Folder) -> DataFrame:
    found = f.category_forecast.metrics().drop("mse")
    return _two_places(found, "rmse").withColumn("r2", F.round("r2", 6))


@query
def category_forecast(f: Folder) -> DataFrame:
    return v.presentable(_two_places(f.category_forecast.forecast(), "sales", "lower_bound", "upper_bound"))


# Customer classes


@query
def customer_averages(f: Folder) -> DataFrame:
    return classify.customer_averages(f.star.fact_sales)


@query
def customer_features(f: Folder) -> DataFrame:
    rows, features = classify.customer_features(f.star.dim_customers, f.star.fact_sales)
    return rows.select("customer_id", "is_high_value", *features)


@query
def customer_split(f: Folder) -> DataFrame:
    return f.customer_model.scored.groupBy("is_high_value").agg(
        F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test")
    )


@query
def customer_model_metrics(f: Folder) -> DataFrame:
    return f.customer_model.metrics()


@query
def customer_confusion(f: Folder) -> DataFrame:
    return f.customer_model.confusion()


@query
def customer_feature_importance(f: Folder) -> DataFrame:
    return f.customer_model.importance()


@query
def customer_predictions(f: Folder) -> DataFrame:
    return f.customer_model.predictions()


# Anomalies


@query
def anomaly_metrics(f: Folder) -> DataFrame:
    return f.anomalies.metrics()


@query
def anomaly_checks(f: Folder) -> DataFrame:
    """All facts are scored once; labels follow the scores; about two in a hundred are flagged."""
    odd = F.col("anomaly_label") == -1
    return f.anomalies.scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("fact_key").alias("facts"),
        F.every(odd == (F.col("anomaly_score") < 0)).alias("labels_agree"),
        (F.count_if(odd) <= F.count(F.lit(1)) * 0.02 + 1).alias("few_flagged"),
    )


@query
def customer_scores(f: Folder) -> DataFrame:
    """Every customer with sales is scored."""
    p = F.col("high_value_probability")
    return f.customer_model.scored.select(
        "customer_key", "customer_tier", "is_high_value", p.between(0, 1).alias("is_share"),
        ((p > 0.5) == (F.col("predicted_high_value") == 1)).alias("agrees"),
    )


@query
def anomaly_samples(f: Folder) -> DataFrame:
    return v.presentable(f.anomalies.samples())


@query
def anomaly_scores(f: Folder) -> DataFrame:
    return v.presentable(f.anomalies.scored)


# Insights and report


@query
def sales_insights(f: Folder) -> DataFrame:
    return insights.with_defaults(insights.sales_insights(f.star))


@query
def all_insights(f: Folder) -> DataFrame:
    return insights.generate_insights(f.spark, f.star, f.sales_model, f.anomalies, f.customer_model)


@query
def executive_report(f: Folder) -> DataFrame:
    lines = insights.generate_insights(f.spark, f.star, f.sales_model, f.anomalies, f.customer_model)
    return report.report_sections(f.profile, f.sales_model, f.customer_model, f.anomalies, lines)


# Shared operators


@query
def numbered_lines(f: Folder) -> DataFrame:
    """Dense numbers over the whole table in a total order."""
    lines = f.spark.read.parquet(f"{f.folder}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return global_row_number(lines.select(*order), order, "line_number").select(*order[:4], "line_number")

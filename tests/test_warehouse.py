import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from ledgerlake import staging
from ledgerlake.errors import EtlFailed, LedgerLakeError, QueryRefused, SchemaMismatch
from ledgerlake.operators.cleaning import Rule
from ledgerlake.plans import dashboard, insights, sqlstudio, warehouse
from ledgerlake.plans.etl import Lake
from ledgerlake.plans.schema import SALES_COLUMNS
from ledgerlake.sources import tables
from ledgerlake.sources.tables import TableStore, clean_identifier
from ledgerlake.staging import new_path

SCHEMA = (
    "order_id string, order_date string, customer_id string, customer_name string, segment string, product_id string,"
    "product_name string, category string, sub_category string, city string, state string, region string,"
    "country string, sales double, quantity double, discount double, profit double"
)


def row(**values):
    base = dict(
        order_id="o1", order_date="2024-01-05", customer_id="c1", customer_name="Ann", segment="Consumer",
        product_id="p1", product_name="Pen", category="Office", sub_category="Art", city="X", state="Y",
        region="East", country="US", sales=10.0, quantity=2.0, discount=0.1, profit=3.0,
    )
    return tuple({**base, **values}[c] for c in SALES_COLUMNS)


def sales(spark, *rows):
    return spark.createDataFrame([row(**r) for r in rows], SCHEMA)


def test_fact_rows_and_dropped_rows(spark):
    raw = sales(
        spark, {}, {"region": None}, {"order_date": "2024-13-45"}, {"order_date": "05/01/2024"},
        {"customer_id": None}, {"product_id": None}, {"quantity": 2.5, "sales": 1.005}, {"quantity": 3.5, "sales": None},
    )
    w = warehouse.build_warehouse(raw)
    facts = w.fact_sales.orderBy("quantity", "sales").collect()
    assert [(r["quantity"], None if r["sales"] is None else str(r["sales"])) for r in facts] == [
        (2, "1.01"), (2, "10.00"), (4, None),
    ]
    assert {r["date_key"] for r in facts} == {20240105}
    assert len({r["fact_key"] for r in facts}) == 3
    lost = warehouse.unplaced_rows(raw).first()
    assert (lost["dated_rows"], lost["no_customer"], lost["no_product"], lost["no_place"]) == (6, 1, 1, 1)


def test_large_dimensions_are_not_broadcast(spark, monkeypatch, tmp_path):
    """A dimension of many rows may be small as files; what counts is its rows."""

    def joins(plan):
        text = plan._jdf.queryExecution().executedPlan().toString()
        return {kind for kind in ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin") if kind in text}

    raw = sales(spark, *[{"customer_id": f"c{i % 3}", "product_id": f"p{i % 4}", "city": f"X{i % 2}", "sales": float(i)} for i in range(12)])
    small = warehouse.build_warehouse(raw)
    assert joins(dashboard.category_performance(small)) == {"BroadcastHashJoin"}
    monkeypatch.setattr(staging, "MOST_BROADCAST", 2)
    large = warehouse.build_warehouse(raw)
    lake = Lake(spark, str(tmp_path))
    for name, table in small.tables().items():
        lake.star.replace(name, table)
    for w in (large, lake.warehouse()):
        assert joins(dashboard.category_performance(w)) == joins(dashboard.top_segment(w)) == {"ShuffledHashJoin"}
        assert joins(dashboard.region_performance(w)) == {"BroadcastHashJoin"}
        assert dashboard.category_performance(w).collect() == dashboard.category_performance(small).collect()
    assert sorted(large.fact_sales.collect()) == sorted(small.fact_sales.collect())


def test_one_variant_per_key(spark):
    w = warehouse.build_warehouse(sales(spark, {"segment": "A"}, {"segment": "B"}, {"segment": None}))
    assert [r["segment"] for r in w.dim_customers.collect()] == ["B"]


def test_second_load_keeps_keys(spark):
    first = warehouse.build_warehouse(sales(spark, {"customer_id": "c2"}, {"customer_id": "c4", "region": None}))
    later = sales(spark, {"customer_id": "c1"}, {"customer_id": "c4", "customer_name": "New", "region": None})
    again = warehouse.build_warehouse(later, first.tables())
    keys = {r["customer_id"]: r["customer_key"] for r in again.dim_customers.collect()}
    assert keys == {"c2": 1, "c4": 2, "c1": 3}
    kept = {r["customer_id"]: r for r in again.dim_customers.collect()}
    assert kept["c4"]["customer_name"] == "New" and kept["c2"]["frequency"] == 1
    # The place without a region is stored once.
    assert again.dim_geography.count() == 2
    assert again.dim_products.count() == 1 and again.fact_sales.count() == 1


def test_customers_without_a_date_are_standard(spark):
    w = warehouse.build_warehouse(sales(spark, {}, {"customer_id": "c9", "order_date": "soon"}))
    dull = w.dim_customers.filter("customer_id = 'c9'").first()
    assert (dull["rfm_score"], dull["customer_tier"], dull["frequency"]) == (0, "Standard", 0)


def test_no_valid_date_at_all(spark):
    w = warehouse.build_warehouse(sales(spark, {"order_date": "soon"}))
    assert w.fact_sales.count() == 0 and w.dim_customers.count() == 1 and w.dim_time.count() == 0
    assert dashboard.kpis(w.fact_sales).first().asDict() == {
        "total_revenue": 0.0, "total_profit": 0.0, "avg_discount": 0.0, "total_orders": 0, "profit_margin": 0.0,
    }
    assert insights.generate_insights(spark, w).filter("text like 'Awaiting%'").count() == 3


def test_insight_rules(spark):
    w = warehouse.build_warehouse(
        sales(spark, {"discount": 0.4, "profit": -5.0, "sales": 1234.5}, {"product_id": "p2", "category": "Chairs", "profit": -1.0})
    )
    text = {r["ord"]: r["text"] for r in insights.generate_insights(spark, w).collect()}
    assert "high at 25.0%" in text[10] and 12 in text
    assert text[20] == "The 'Consumer' segment leads in total volume, generating $1,244.5 in revenue."
    assert text[30] == "Identified net-unprofitable categories: Chairs, Office."
    assert "too short" in text[56]
    healthy = warehouse.build_warehouse(sales(spark, {}))
    lines = insights.generate_insights(spark, healthy).filter("ord = 1000").collect()
    assert sorted(r["section"] for r in lines) == ["business_risks", "recommended_actions"]


def test_missing_columns(spark):
    with pytest.raises(SchemaMismatch):
        warehouse.build_dimensions(sales(spark, {}).drop("profit"))


def test_summary_of_missing_tables(spark):
    rows = dashboard.summary(spark, {"fact_sales": None}).drop("role").collect()
    assert [tuple(r) for r in rows] == [("fact_sales", False, 0)]


@pytest.fixture
def lake(spark):
    return Lake(spark, new_path(spark, "lake"))


def loaded(spark, *rows):
    from pyspark.sql import functions as F

    return sales(spark, *rows).coalesce(1).withColumn("ingest_pos", F.monotonically_increasing_id())


def test_full_run_twice(spark, lake):
    assert lake.warehouse() is None
    lake.raw.replace("sales", loaded(spark, {}, {}, {"sales": None, "order_date": "2024/02/01", "customer_id": "c0"}))
    steps = lake.run("sales")
    assert [s["status"] for s in steps] == ["COMPLETED"] * 4
    assert steps[1]["logs"][0] == "Dropped 1 duplicate rows."
    before = {r["customer_id"]: r["customer_key"] for r in lake.star.scan("dim_customers").collect()}
    assert lake.star.scan("fact_sales").count() == 2
    lake.run("sales")
    assert {r["customer_id"]: r["customer_key"] for r in lake.star.scan("dim_customers").collect()} == before
    runs = lake.audit.runs().collect()
    assert [r["status"] for r in runs] == ["COMPLETED"] * 2 and runs[0]["started_at"] >= runs[1]["started_at"]
    assert lake.audit.history("sales").count() == 2 and lake.audit.history("other").count() == 0
    assert lake.raw.versions().count() == 3


def test_second_load_rewrites_only_the_files_it_touches(spark):
    store = TableStore(spark, new_path(spark, "ranged"), "warehouse")

    def merge(rows):
        frame = spark.createDataFrame(rows, "id string, place string, label string")
        store.merge("dim", frame, ["id", "place"][:1], ["place", "label"], "key", 10)
        return {f["path"] for f in store._files("dim")}

    first = merge([(f"k{i:03d}", "p", "old") for i in range(0, 200, 2)])
    keys = {r["id"]: r["key"] for r in store.find("dim").collect()}
    assert len(first) >= 8 and sorted(keys.values()) == list(range(1, 101))
    assert merge([("k010", "p", "old"), ("k150", "p", "old")]) == first  # nothing changes
    second = merge([("k020", "p", "new"), ("k021", None, "new"), ("k022", "p", "old"), ("a", "p", "first"), ("z", "p", "last")])
    assert 1 <= len(first - second) <= 4 and len(first & second) >= len(first) - 4
    rows = {r["id"]: (r["key"], r["place"], r["label"]) for r in store.find("dim").collect()}
    assert len(rows) == 103 and rows["k020"] == (keys["k020"], "p", "new") and rows["k198"] == (keys["k198"], "p", "old")
    assert {i: rows[i] for i in ("a", "k021", "z")} == {"a": (101, "p", "first"), "k021": (102, None, "new"), "z": (103, "p", "last")}
    third = merge([(f"k{i:03d}", "p", "odd") for i in range(1, 200, 2)])
    files = sorted((f["low"], f["high"]) for f in store._files("dim"))
    assert all(a[1] < b[0] for a, b in zip(files, files[1:])) and len(third) == len(files) >= 15
    rows = store.find("dim").collect()
    assert len({r["id"] for r in rows}) == len(rows) == 202 and len({r["key"] for r in rows}) == 202


def test_large_tables_have_larger_files(spark, monkeypatch):
    """The number of files is bounded, whatever rows were asked for; rows and keys are the same."""
    monkeypatch.setattr(tables, "MOST_FILES", 4)
    store = TableStore(spark, new_path(spark, "ranged"), "warehouse")
    frame = lambda step, label: spark.range(0, 200, step).select(F.format_string("k%03d", "id").alias("id"), F.lit(label).alias("label"))
    store.merge("dim", frame(2, "old"), ["id"], ["label"], "key", 10)
    assert len(store._files("dim")) <= 5
    store.merge("dim", frame(1, "new"), ["id"], ["label"], "key", 10)
    rows = store.find("dim").collect()
    assert len(store._files("dim")) <= 10 and len(rows) == 200 and {r["label"] for r in rows} == {"new"}
    assert {r["key"] for r in rows} == set(range(1, 201)) and all(r["key"] <= 100 for r in rows if int(r["id"][1:]) % 2 == 0)


def test_facts_are_joined_once(spark, lake):
    """The joined rows are written before they are counted per day and numbered."""
    lake.raw.replace("sales", loaded(spark, *[{"order_id": f"o{i}"} for i in range(5)]))
    lake.run("sales")
    w = lake.warehouse()
    rows = warehouse.facts(lake.raw.scan("sales"), w.dim_customers, w.dim_products, w.dim_geography)
    assert "customer_id" not in rows._jdf.queryExecution().analyzed().toString()
    assert sorted(r["fact_key"] for r in rows.collect()) == list(range(1, 6))


def test_ranged_tables_in_a_lake(spark, lake, monkeypatch):
    """Tables written whole before are taken over; several files are one SQL table."""
    monkeypatch.setattr(TableStore.merge, "__defaults__", (2,))
    days = [{"order_id": f"o{i}", "product_id": f"p{i}", "city": f"c{i}", "region": None if i == 3 else "r"} for i in range(7)]
    lake.raw.replace("sales", loaded(spark, *days))
    lake.star.replace("dim_products", spark.createDataFrame([(1, "p3", "n", "c", "s")], "product_key bigint, product_id string, product_name string, category string, sub_category string"))
    lake.run("sales")
    w = lake.warehouse()
    assert isinstance(w.paths["dim_products"], list) and w.dim_products.count() == 7
    assert w.dim_products.filter("product_id = 'p3'").first()["product_key"] == 1
    before = {tuple(r) for r in w.dim_geography.collect()}
    lake.run("sales")
    assert {tuple(r) for r in lake.warehouse().dim_geography.collect()} == before and len(before) == 7
    sqlstudio.register(spark, lake.warehouse())
    text = "SELECT COUNT(*) AS n FROM warehouse.dim_products p JOIN warehouse.fact_sales f ON p.product_key = f.product_key"
    assert sqlstudio.answer(spark, text).rows == [{"n": 7}]
    sqlstudio.register(spark, lake.warehouse())


def test_failed_run_is_recorded(spark, lake):
    lake.raw.replace("sales", loaded(spark, {}).drop("profit"))
    with pytest.raises(EtlFailed):
        lake.run("sales")
    last = lake.audit.runs().first()
    assert last["status"] == "FAILED" and last["steps_completed"][-1]["error"].endswith("profit")


def test_preview_writes_nothing(spark, lake):
    lake.raw.replace("sales", loaded(spark, *[{"order_id": str(i)} for i in range(60)], {"order_id": "0"}))
    shown = lake.clean("sales", [Rule("remove_duplicates")], preview_only=True)
    assert shown.row_count == 60 and shown.preview.count() == 50
    assert lake.raw.scan("sales").count() == 61 and lake.audit.history("sales").count() == 0
    lake.clean("sales", [Rule("remove_duplicates")])
    assert lake.raw.scan("SALES;").count() == 60


def test_upper_case_columns_are_lowered(spark, lake):
    raw = loaded(spark, {}).withColumnRenamed("city", "City")
    lake.raw.replace("sales", raw)
    lake.normalise_casing("sales")
    assert "city" in lake.raw.scan("sales").columns


def test_table_names(spark, lake):
    assert clean_identifier(" Sales'; ") == "sales"
    with pytest.raises(LedgerLakeError):
        clean_identifier("a b")
    with pytest.raises(LedgerLakeError):
        lake.raw.scan("nothing")


def test_sql(spark):
    w = warehouse.build_warehouse(sales(spark, {}, {"sales": 5.0, "order_date": "2024-02-01"}))
    sqlstudio.register(spark, w)
    result = sqlstudio.answer(spark, "SELECT sales, 'warehouse.x' AS t FROM warehouse.fact_sales ORDER BY sales DESC; ")
    assert result.rows == [{"sales": 10.0, "t": "warehouse.x"}, {"sales": 5.0, "t": "warehouse.x"}]
    assert result.columns == ["sales", "t"] and result.row_count == 2
    assert sqlstudio.answer(spark, "with d as (select max(full_date) m from warehouse.dim_time) select m from d").rows == [
        {"m": "2024-02-01"}
    ]
    assert sqlstudio.query(spark, "SELECT id FROM range(5000)").count() == 1000


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE warehouse.fact_sales",
        "select 1; drop table warehouse.fact_sales",
        "with x as (select 1) insert into warehouse.dim_time select * from x",
        "select reflect('java.lang.System', 'exit', 0)",
        "select transform(a) using 'cat' from (select 1 as a)",
        "select nothing from nowhere",
    ],
)
def test_refused_sql(spark, text):
    with pytest.raises(QueryRefused):
        sqlstudio.answer(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "select `reflect`('java.lang.Math', 'abs', -5)",
        "select reflect/**/('java.lang.Math', 'abs', -5)",
        "select * from text.`/etc/hostname`",
        "select * from default.other",
        "with a as (select 1 x) select * from b",
        "select (select max(value) from text.`/etc/hostname`)",
        "select * from warehouse.dim_time where exists (select 1 from csv.`/tmp/x`)",
        "select * from identifier('text.`/etc/hostname`')",
        "select transform(a) using 'cat' from warehouse.dim_time",
        "with `text./etc/hostname` as (select 1 as x) select * from text.`/etc/hostname`",
        "select o.x from (with session_view as (select 1 as x) select * from session_view) i, session_view o",
        "select * from session_view",
        "select * from global_temp.everyone_sees_it",
        "select * from warehouse.dim_time where date_key in (select x from session_view)",
        "select * from warehouse.not_a_role",
        "select not_a_role.x from warehouse.dim_time, lateral (select * from not_a_role)",
        "select try_reflect('java.lang.Math', 'abs', -5)",
        "select own_code(date_key) from warehouse.dim_time",
        "select * from (table text.`/etc/hostname`)",
        "select * from spark_catalog.default.other",
        "select * from warehouse.dim_time version as of 1",
    ],
)
def test_sql_gate_refuses(spark, gated, text):
    with pytest.raises((QueryRefused, ParseException)):
        sqlstudio.query(spark, text)


@pytest.fixture(scope="module")
def gated(spark):
    """A warehouse beside things of the session that queries must not reach."""
    w = warehouse.build_warehouse(sales(spark, {}, {"sales": 5.0, "order_date": "2024-02-01"}))
    sqlstudio.register(spark, w)
    spark.range(1).toDF("x").createOrReplaceTempView("session_view")
    spark.range(1).toDF("x").createOrReplaceGlobalTempView("everyone_sees_it")
    spark.sql("CREATE OR REPLACE VIEW warehouse.not_a_role AS SELECT 1 AS x")
    spark.udf.register("own_code", lambda x: x, "int")
    yield w
    spark.sql("DROP VIEW warehouse.not_a_role")
    spark.catalog.dropTempView("session_view")
    spark.catalog.dropGlobalTempView("everyone_sees_it")


@pytest.mark.parametrize(
    "text, rows",
    [
        ("select count(*) n from warehouse.fact_sales where date_key in (select date_key from warehouse.dim_time where month = 2)", 1),
        ("select count(*) n from warehouse.fact_sales f where exists (select 1 from warehouse.dim_time t where t.date_key = f.date_key)", 2),
        ("select (select count(*) from warehouse.fact_sales) n", 2),
        ("select count(*) n from warehouse.dim_time t, lateral (select * from warehouse.fact_sales f where f.date_key = t.date_key)", 2),
        ("with session_view as (select 1 x), b as (select * from session_view) select count(*) n from b join session_view using (x)", 1),
        ("with a as (select 1 n), b as (with a as (select 2 n) select * from a) select b.n from a, b", 2),
        ("select count(*) n from SPARK_CATALOG.Warehouse.Fact_Sales", 2),
        ("select sum(x) n from (values (1), (2)) v(x)", 3),
        ("select count(*) n from warehouse.dim_time lateral view explode(array(1, 2)) e as x where month = 2", 2),
        ("select max(n) n from (select count(*) over (partition by customer_key) n from warehouse.fact_sales)", 2),
        ("select count(*) n from (select date_key from warehouse.dim_time union select 1 intersect select 1)", 3),
    ],
)
def test_sql_gate_answers(spark, gated, text, rows):
    assert [r["n"] for r in sqlstudio.answer(spark, text).rows] == [rows]


def test_sql_gate_reads_the_query_not_its_words(spark):
    rows = sqlstudio.answer(spark, "select 'reflect(x)' as a from range(5)", limit=3)
    assert rows.row_count == 3 and rows.cut and rows.rows[0] == {"a": "reflect(x)"}
    assert not sqlstudio.answer(spark, "with r as (select id from range(3)) select * from r").cut


def test_anomalies_do_not_depend_on_partitions(spark):
    from ledgerlake.operators.isolation import detect_anomalies

    rows = spark.range(700).selectExpr(
        "id AS fact_key", "string(id % 90) AS order_id", "id % 7 AS product_key", "double(hash(id) % 1000) AS sales",
        "int(id % 9) AS quantity", "double(id % 5) / 10 AS discount", "double(hash(id, 1) % 300) AS profit",
    )
    products = spark.range(7).selectExpr("id AS product_key", "string(id) AS product_name")
    flagged = [
        sorted(r["fact_key"] for r in detect_anomalies(rows.repartition(n), products, trees=20).flagged().collect()) for n in (3, 5)
    ]
    assert flagged[0] == flagged[1] and len(flagged[0]) == 14


@pytest.mark.parametrize("rows", [257, 262, 268, 1500])
def test_every_tree_gets_its_whole_sample(spark, rows):
    from ledgerlake.operators.isolation import tree_samples

    table = spark.range(rows).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in tree_samples(table, "k", rows, 256, 42).groupBy("tree").count().collect()]
    assert sizes == [256] * 100


def test_report_without_models(spark):
    w = warehouse.build_warehouse(sales(spark, {}, {"sales": 5.0, "order_date": "2024-02-01"}))
    rows = insights.insights_for(spark, w).collect()
    assert any("too short" in r["text"] for r in rows)

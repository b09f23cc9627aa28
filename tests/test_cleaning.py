import os

from pyspark.sql import functions as F

from ledgerlake.functions.dates import RECOVERING_FORMATS, date_reading, is_iso_date, parse_date
from ledgerlake.operators.cleaning import Rule, apply_rules, keep_first, recommend_rules, rules_list
from ledgerlake.operators.fills import BLOCK_BITS, forward_then_backward
from ledgerlake.operators.profile import Profile
from ledgerlake.operators.quality import consistency


def test_fill_in_row_order(spark):
    rows = [(0, None), (1, "2024-01-02"), (2, None), (3, "bad"), (4, "2024-01-05"), (5, None)]
    df = spark.createDataFrame(rows, "ingest_pos bigint, order_date string")
    out, logs = apply_rules(df, [Rule("standardize_dates", "order_date")], "ingest_pos")
    assert [r["order_date"] for r in out.orderBy("ingest_pos").collect()] == [
        "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-02", "2024-01-05", "2024-01-05",
    ]
    assert logs == ["Standardized date formatting in 'order_date' to YYYY-MM-DD. 1 values could not be read and took a neighbour's date."]


def test_unread_dates_are_counted_and_kept_on_request(spark):
    texts = ["13/01/2016", "14/02/2016", None, "15/03/2016", "16/04/2016", "01/25/2017", "02/26/2017", "1/2/16", "unknown", "31.12.69"]
    df = spark.createDataFrame([*enumerate(texts)], "ingest_pos bigint, order_date string")
    read = ["2016-01-13", "2016-02-14", None, "2016-03-15", "2016-04-16", "2017-01-25", "2017-02-26", "2016-01-02", None, "1969-12-31"]

    def run(unread):
        out, logs = apply_rules(df, [Rule("standardize_dates", "order_date", parameters={"unread": unread})], "ingest_pos")
        assert "1 values could not be read" in logs[0]
        return [r["order_date"] for r in out.orderBy("ingest_pos").collect()]

    assert run("keep") == read[:2] + [read[1]] + read[3:8] + ["unknown"] + read[9:]
    assert run("null") == read
    assert run("fill") == read[:2] + [read[1]] + read[3:8] + [read[7]] + read[9:]
    profile = Profile(df.drop("ingest_pos"))
    assert consistency(profile, None).first()["score"] == 88.89 and consistency(profile).first()["score"] == 0


def test_gaps_stay_when_every_date_parses(spark):
    df = spark.createDataFrame([(0, "2024/01/02"), (1, None), (2, "03-01-2024")], "ingest_pos bigint, d_date string")
    out, _ = apply_rules(df, [Rule("standardize_dates", "d_date")], "ingest_pos")
    assert [r["d_date"] for r in out.orderBy("ingest_pos").collect()] == ["2024-01-02", None, "2024-01-03"]


def test_fill_carries_over_blocks(spark):
    step = 1 << (BLOCK_BITS - 1)
    days = {3: "2024-01-01", 9: "2024-02-01"}
    rows = [(i * step, days.get(i)) for i in range(14)]
    df = spark.createDataFrame(rows, "p bigint, d string").withColumn("d", F.col("d").cast("date"))
    filled = [str(r["d"]) for r in forward_then_backward(df, "d", "p").orderBy("p").collect()]
    assert filled == ["2024-01-01"] * 9 + ["2024-02-01"] * 5


def test_filling_shuffles_positions_and_values_only(spark):
    """Whole rows that hold a value are neither sorted nor shuffled; those with a gap meet theirs by position."""
    rows = [(i, None if i % 7 == 3 else f"2024-01-{i % 28 + 1:02d}", f"wide-{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "p bigint, d string, w string").withColumn("d", F.col("d").cast("date"))
    filled = forward_then_backward(df, "d", "p")
    found = [(r["p"], str(r["d"]), r["w"]) for r in filled.orderBy("p").collect()]
    assert found == [(i, rows[i - (i % 7 == 3)][1], w) for i, _, w in rows]
    assert "Window" not in filled._jdf.queryExecution().optimizedPlan().toString()


def test_filling_writes_positions_and_values_only(spark, monkeypatch):
    from ledgerlake import staging

    written, write = [], staging.stage_at
    monkeypatch.setattr(staging, "stage_at", lambda df, *to: (written.append(df.columns), write(df, *to))[1])
    rows = [(i, None if i % 7 == 3 else f"2024-01-{i % 28 + 1:02d}", f"wide-{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "p bigint, d string, w string").withColumn("d", F.col("d").cast("date"))
    assert forward_then_backward(df, "d", "p").count() == 100
    assert written and not any("w" in columns for columns in written)
    # Positions that another run might number otherwise are written with their rows.
    numbered = df.orderBy("p").coalesce(1).drop("p").withColumn("p", F.monotonically_increasing_id())
    found = [(str(r["d"]), r["w"]) for r in forward_then_backward(numbered, "d", "p").orderBy("p").collect()]
    assert found == [(rows[i - (i % 7 == 3)][1], w) for i, _, w in rows] and any("w" in columns for columns in written)


def test_filters_keep_rows_from_what_they_guard(spark):
    """A cast that would fail on rows that were filtered out does not meet them, whatever filters come later."""
    texts = ["2024-01-05", "16-01-1999", None, "2024-01-05", "2024-01-07"]
    df = spark.createDataFrame(list(enumerate(texts)), "p bigint, t string").filter(is_iso_date(F.col("t")) | F.col("t").isNull())
    df = df.select("p", F.when(F.col("p") == 3, "unknown").otherwise(F.date_format(F.col("t").cast("date"), "M/d/yyyy")).alias("d_date"))
    out, _ = apply_rules(df, [Rule("standardize_dates", "d_date", parameters={"unread": "keep"}), Rule("remove_duplicates")], "p")
    found = [(r["p"], r["d_date"]) for r in out.orderBy("p").collect()]
    assert found == [(0, "2024-01-05"), (3, "unknown"), (4, "2024-01-07")]


def test_intermediates_are_removed(spark):
    """What is staged inside goes, also what was staged by jobs submitted together; what has a path of its own stays."""
    from ledgerlake import staging

    df, inside = spark.range(10).toDF("x"), []

    def job():
        inside.append(staging.stage(df, "inside"))
        return inside[-1].count()

    with staging.scratch(spark):
        assert staging.together(spark, job, job) == [10, 10]
        kept = staging.stage_at(inside[0], staging.new_path(spark, "kept"))
    after = staging.stage(df, "after")
    there = [os.path.exists(t.inputFiles()[0].removeprefix("file://")) for t in (*inside, kept, after)]
    assert there == [False, False, True, True]


def test_texts_in_odd_forms_are_read_as_before(spark):
    """A text that only looks like a plain date is no date, and the forms that a column needs are found."""
    odd = ["2024-01-5T", "2024-01-5\t", "+024-01-05", "2024-1--05", "2024-/1-05", "2024/-1/05", "2024-01/05", "2024-01-0\u0663", "2024-13-01", ""]
    day = {"2024-01-05": "2024-01-05", "2024/01/06": "2024-01-06", "25-01-2024": "2024-01-25", "2024-1-7": "2024-01-07", " 2024-01-08 ": "2024-01-08", "2024-01-09 10:00": "2024-01-09"}
    df = spark.createDataFrame([(t,) for t in [*odd, *day, None]], "d_date string")
    reading = date_reading(df, "d_date")
    assert (reading.read, reading.lost) == (len(day), len(odd)) and reading.formats.index("d-M-yyyy") < reading.formats.index("M-d-yyyy")
    read = parse_date(F.trim("d_date"), reading.formats, True)
    found = {r["d_date"]: r["d"] for r in df.select("d_date", read.cast("string").alias("d")).collect()}
    assert found == {**dict.fromkeys([*odd, None]), **day}
    # The many forms stay out of the generated code, which would be too long to be compiled.
    code = df.select(read.alias("d"))._jdf.queryExecution().debug().codegenToSeq().apply(0)._2()
    assert len(code) < 40_000


def test_dates_cast_as_a_formatter_reads_them(spark):
    """Days that do not exist and the year 0 stay unread in both fixed forms, with and without a time of day."""
    texts = ["2024-02-29", "2023-02-29", "2024/12/31", "2024/13/01", "0000-01-01", "0001-01-01", "2024-1-2", "2024-01-02T08:30:00Z", "2024/01-02", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, timed = (df.select(parse_date(F.col("t"), RECOVERING_FORMATS[:2], w).cast("string").alias("d")).collect() for w in (False, True))
    read = ["2024-02-29", None, "2024-12-31", None, None, "0001-01-01", None]
    assert [r["d"] for r in plain] == [*read, None, None, None]
    assert [r["d"] for r in timed] == [*read, "2024-01-02", None, None]
    assert "try_to_date" not in str(parse_date(F.col("t"), RECOVERING_FORMATS[:2])).lower()


def test_fill_methods(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 1, "b", None), (1, None, None, "a", None), (2, 4.0, 4, None, None), (3, 10.0, 5, "a", None)],
        "ingest_pos bigint, x double, n bigint, s string, e string",
    )

    def fill(column, method):
        out, logs = apply_rules(df, [Rule("fill_nulls", column, parameters={"method": method})], "ingest_pos")
        return {r["ingest_pos"]: r[column] for r in out.collect()}, logs

    assert fill("x", "mean")[0][1] == 5.0
    values, logs = fill("x", "median")
    assert values[1] == 4.0 and logs == ["Filled 1 nulls in 'x' using median (value: 4.0)."]
    assert fill("n", "median")[0][1] == 4.0
    assert fill("s", "mode")[0][2] == "a"
    assert fill("s", "median")[0][2] == "a"
    assert fill("e", "mode")[0][0] == "N/A"
    assert fill("x", "mode")[0][1] == 1.0


def test_rules_apply_in_order_and_strangers_are_ignored(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, None), (3, 3.0)], "ingest_pos bigint, x double")
    fill = Rule("fill_nulls", "x", parameters={"method": "mean"})
    out, logs = apply_rules(df, [Rule("shine"), Rule("fill_nulls", "y"), Rule("remove_duplicates"), fill], "ingest_pos")
    assert sorted((r["ingest_pos"], r["x"]) for r in out.collect()) == [(0, 1.0), (2, 2.0), (3, 3.0)]
    assert logs[0] == "Dropped 1 duplicate rows."
    out, _ = apply_rules(df, [fill, Rule("remove_duplicates")], "ingest_pos")
    assert out.count() == 3


def test_first_copy_is_kept(spark):
    df = spark.createDataFrame([(5, "a", None), (2, "a", None), (3, "b", 1)], "ingest_pos bigint, s string, x int")
    assert sorted(r["ingest_pos"] for r in keep_first(df, "ingest_pos").collect()) == [2, 3]


def test_recommended_rules(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 1.0, "a"), ("2024-01-01", 1.0, "a"), ("1 May", None, None)],
        "order_date string, sales double, segment string",
    )
    rules = rules_list(recommend_rules(Profile(df)))
    assert [(r.type, r.column, r.severity) for r in rules] == [
        ("remove_duplicates", None, "medium"),
        ("fill_nulls", "sales", "high"),
        ("fill_nulls", "segment", "high"),
        ("standardize_dates", "order_date", "high"),
    ]
    assert [r.method for r in rules[1:3]] == ["median", "mode"]
    clean = spark.createDataFrame([("2024-01-01", 1.0)], "order_date string, sales double")
    assert rules_list(recommend_rules(Profile(clean))) == []

"""Read-only SQL over the warehouse tables."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.errors import QueryRefused
from ledgerlake.functions.values import presentable
from ledgerlake.plans.schema import TABLE_ROLES, Warehouse
from ledgerlake.staging import shared_dir

ROW_LIMIT = 1000
DATABASE = "warehouse"

# Where tables of the session's own catalog live.
_CATALOG = "spark_catalog"
# Parsed nodes that read something before the query is analysed, or name it only then.
_REFUSED_PARSED = ("ScriptTransformation", "UnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "RelationTimeTravel")
# What an analysed query may consist of; relations are told by their catalog entry.
_OPERATORS = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
    "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "LogicalRelation", "Offset",
    "OneRowRelation", "OneRowSubquery", "Pivot", "Project", "Range", "RebalancePartitions", "Repartition",
    "RepartitionByExpression", "ResolvedHint", "ResolvedInlineTable", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot",
    "Window", "WithCTE", "WithWindowDefinition",
}
# Expressions that run code outside the query, by a part of their class names.
_FOREIGN_CODE = ("Reflect", "Python", "ScalaUD", "ScalaAgg", "UserDefined", "Hive", "TypedAgg", "ObjectAggregator")

# Names and texts of the saved queries.
SAVED_QUERIES = {
    "Get High-Value Customers": """
        SELECT customer_id, customer_name, monetary_value, customer_tier
        FROM warehouse.dim_customers
        WHERE customer_tier = 'Platinum'
        ORDER BY monetary_value DESC, customer_id""",
    "Revenue by Product Category": """
        SELECT p.category, SUM(f.sales) AS total_sales, SUM(f.profit) AS total_profit
        FROM warehouse.fact_sales f
        JOIN warehouse.dim_products p ON f.product_key = p.product_key
        GROUP BY p.category
        ORDER BY total_sales DESC""",
    "Top Cities by Sales Volume": """
        SELECT g.city, g.state, SUM(f.sales) AS city_sales
        FROM warehouse.fact_sales f
        JOIN warehouse.dim_geography g ON f.geo_key = g.geo_key
        GROUP BY g.city, g.state
        ORDER BY city_sales DESC, g.city
        LIMIT 15""",
}


def register(spark: SparkSession, w: Warehouse) -> None:
    """Make the written tables known to SQL as ``warehouse.<table>``; one that consists of files, as a view of them."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_dir(spark)}/{DATABASE}.db'")
    kinds = {r["name"]: r["tableType"] for r in (t._asdict() for t in spark.catalog.listTables(DATABASE)) if not r["isTemporary"]}
    for name, path in w.paths.items():
        if name in kinds:
            spark.sql(f"DROP {'VIEW' if kinds[name] == 'VIEW' else 'TABLE'} {DATABASE}.{name}")
        if isinstance(path, str):
            spark.catalog.createTable(f"{DATABASE}.{name}", path=path, source="parquet")
        else:
            spark.sql(f"CREATE VIEW {DATABASE}.{name} AS " + " UNION ALL ".join(f"SELECT * FROM parquet.`{p}`" for p in path))


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


class _Walk:
    """All nodes of a plan: operators, expressions, subqueries and named subqueries."""

    def __init__(self, spark: SparkSession):
        load = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
        self._plan = load("org.apache.spark.sql.catalyst.plans.QueryPlan")
        self._holds_plan = load("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def is_operator(self, node) -> bool:
        return self._plan.isInstance(node)

    def nodes(self, root) -> Iterator[tuple[str, object]]:
        waiting = [root]
        while waiting:
            node = waiting.pop()
            kind = node.getClass().getSimpleName()
            yield kind, node
            if kind == "View" and _is_own(node.desc()):
                continue
            waiting += _items(node.children())
            if self.is_operator(node):
                waiting += _items(node.expressions())
            if self._holds_plan.isInstance(node):
                waiting.append(node.plan())
            if kind == "UnresolvedWith":
                waiting += (pair._2() for pair in _items(node.cteRelations()))


def _check_parsed(spark: SparkSession, statement: str) -> None:
    """Refuses what could reach a file while the query is analysed.

    A name of one part is a named subquery, a view or a table, which the
    analysed plan will tell; names of more parts must be a warehouse table's,
    part by part, for ``format.`path``` has two parts as well.
    """
    for kind, node in _Walk(spark).nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)):
        if kind in _REFUSED_PARSED:
            raise QueryRefused("the query may only read the warehouse tables by name")
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            own = parts[1:] if parts[0] == _CATALOG else parts
            if len(parts) > 1 and not (len(own) == 2 and own[0] == DATABASE and own[1] in TABLE_ROLES):
                raise QueryRefused(f"'{'.'.join(parts)}' is not a warehouse table")


def _is_own(entry) -> bool:
    """Whether a catalog entry is a table of the warehouse, or its view of a table's files."""
    name = entry.identifier()
    catalog = name.catalog().get() if name.catalog().isDefined() else _CATALOG
    database = name.database().get() if name.database().isDefined() else None
    return catalog == _CATALOG and database == DATABASE and name.table() in TABLE_ROLES


def _check_analysed(spark: SparkSession, plan) -> None:
    """Refuses an analysed plan that holds anything but relational operators over the warehouse's tables.

    Names are resolved here: named subqueries are inlined or referred to by
    number, and every relation carries the catalog entry that it stands for,
    whatever the text calls it. Views of others, files, cached and streamed
    data are other nodes and stay outside.
    """
    walk = _Walk(spark)
    for kind, node in walk.nodes(plan):
        if walk.is_operator(node):
            if kind == "View" and _is_own(node.desc()):
                continue
            if kind not in _OPERATORS:
                raise QueryRefused(f"the query may only read the warehouse tables by name ({kind})")
            if kind == "LogicalRelation" and not (node.catalogTable().isDefined() and _is_own(node.catalogTable().get())):
                raise QueryRefused("the query reads a table outside the warehouse")
        elif any(part in kind for part in _FOREIGN_CODE):
            raise QueryRefused(f"functions that run other code are not allowed ({kind})")


def query(spark: SparkSession, text: str, limit: int = ROW_LIMIT) -> DataFrame:
    """Rows of a SELECT or WITH statement over the warehouse tables, at most ``limit``.

    The text is read as a subquery, so a command or a second statement is a
    syntax error before anything runs. What Spark's analyser makes of it is
    checked, not its words: each relation by its catalog entry.
    """
    statement = text.strip().rstrip(";").strip()
    if not re.match(r"(select|with)\b", statement, re.I):
        raise QueryRefused("queries start with SELECT or WITH")
    _check_parsed(spark, statement)
    try:
        result = spark.sql(f"SELECT * FROM (\n{statement}\n) LIMIT {int(limit)}")
    except AnalysisException as problem:
        if problem.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        raise QueryRefused("the query names a table that is not in the warehouse") from problem
    _check_analysed(spark, result._jdf.queryExecution().analyzed())
    return result


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[dict]
    row_count: int
    execution_time_ms: int
    #: Whether there were more rows than the limit.
    cut: bool = False


class QueryFailed(QueryRefused):
    def __init__(self, problem: Exception, execution_time_ms: int):
        super().__init__(str(problem))
        self.execution_time_ms = execution_time_ms


def answer(spark: SparkSession, text: str, limit: int = ROW_LIMIT) -> Answer:
    """Run a query and bring up to ``limit`` rows to the caller, with dates as text and decimals as double."""
    start = time.monotonic()

    def elapsed() -> int:
        return int((time.monotonic() - start) * 1000)

    try:
        result = presentable(query(spark, text, limit + 1))
        rows = [r.asDict() for r in result.collect()]
    except QueryRefused:
        raise
    except Exception as problem:
        raise QueryFailed(problem, elapsed()) from problem
    kept = rows[:limit]
    return Answer(result.columns, kept, len(kept), elapsed(), len(rows) > limit)

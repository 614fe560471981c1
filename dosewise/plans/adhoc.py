"""Read-only ad-hoc SQL over the registered layers (API-1, API-2, FLT-20).

Model-written SQL runs over temporary views of the layers, with named
parameters instead of string building.  What may run is decided on the parsed
plan, not on the statement's first word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dosewise.operators import quality as Q

# Commands that only report on the catalog or on a plan.
REPORTS = {"ShowTables", "ShowTablesCommand", "ShowColumns", "ShowColumnsCommand", "ShowNamespaces", "ShowFunctions",
           "ShowTableProperties", "ShowViews", "DescribeRelation", "DescribeColumn", "DescribeQueryCommand",
           "DescribeNamespace", "DescribeFunction", "ExplainCommand"}
# What a query is made of when it is parsed.  Any other node is refused, whatever it does.
QUERY_NODES = {
    "Aggregate", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "Range", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedGenerator", "UnresolvedHaving",
    "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases",
    "UnresolvedWith", "Unpivot", "View", "Window", "WithWindowDefinition"}
# Expressions that name something only when they are evaluated.
LATE_NAMES = {"ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"}
# Built-in functions that call code by its name or read a file: not for queries of others.
UNSAFE_FUNCTIONS = {"reflect", "java_method", "try_reflect", "from_protobuf", "to_protobuf"}

# View name -> attribute of ``Layers``.
VIEWS = {
    "partd_raw": "partd", "payments_raw": "payments", "drug_map": "drug_map",
    "rx_by_npi_drug": "rx", "pay_by_npi_drug": "pay", "doctors": "doctors",
    "doctor_drug": "dd", "doctor_drug_mfr": "mfr",
}


class NotReadOnly(ValueError):
    pass


def register_views(spark: SparkSession, layers) -> list[str]:
    for view, attr in VIEWS.items():
        getattr(layers, attr).createOrReplaceTempView(view)
    return list(VIEWS)


def _each(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def _allowed_functions(spark: SparkSession) -> set[str]:
    """Spark's own functions but the unsafe ones; functions that a session has registered run foreign code."""
    return {r.function.lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - UNSAFE_FUNCTIONS


def _require_read_only(spark: SparkSession, plan) -> None:
    """Refuse a parsed plan with any node that is no part of a query or report, a
    table that is a path, a name made at run time, or a function that is not
    one of Spark's own safe ones: in subqueries, common tables, EXPLAIN and
    expressions at any depth."""
    functions = None

    def function(parts) -> None:
        nonlocal functions
        functions = functions or _allowed_functions(spark)
        names = [p.lower() for p in _each(parts)]
        if names[-1] not in functions or names[:-1] not in ([], ["builtin"], ["system", "builtin"]):
            raise NotReadOnly(f"the function {'.'.join(names)} may not be used here")

    def relation(parts) -> None:
        names = list(_each(parts))
        if len(names) > 1 and not (names[0] in ("spark_catalog", "global_temp") or (len(names) == 2 and "/" not in names[1] and spark.catalog.databaseExists(names[0]))):
            raise NotReadOnly("only registered tables can be read, not paths")

    todo, expressions = [plan], []
    while todo or expressions:
        if expressions:
            e = expressions.pop()
            name = e.getClass().getSimpleName()
            if name in LATE_NAMES:
                raise NotReadOnly("names made at run time may not be used here")
            if name == "UnresolvedFunction":
                function(e.nameParts())
            expressions += _each(e.children())
            continue
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name in REPORTS:
            if name == "ExplainCommand":
                todo.append(p.logicalPlan())
            elif name == "DescribeQueryCommand":
                todo.append(p.plan())
            continue
        if name not in QUERY_NODES:
            raise NotReadOnly(f"this statement does more than query or report ({name}); only queries and reports run here")
        if name == "UnresolvedRelation":
            relation(p.multipartIdentifier())
        elif name == "UnresolvedTableValuedFunction":
            function(p.name())
        expressions += _each(p.expressions())
        todo += [*_each(p.children()), *_each(p.subqueriesAll())]
        if name == "UnresolvedWith":
            for pair in _each(p.cteRelations()):
                todo.append(pair.productElement(1))


def run_query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """API-1 / FLT-20: the statement is parsed and its whole plan checked before
    anything runs: queries, SHOW, DESCRIBE and EXPLAIN pass; whatever else it
    holds, at any depth, is refused."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql or "")
    _require_read_only(spark, parsed)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def list_tables(layers) -> DataFrame:
    """API-2: registered tables with row counts, largest first."""
    return Q.table_counts({view: getattr(layers, attr) for view, attr in VIEWS.items()})

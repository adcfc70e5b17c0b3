"""Read-only SQL over named tables: what is checked, and how it runs.

Spark parses the statement, and the parsed tree is checked: plan nodes and expressions by their
class, tables and functions by name. Then Spark analyses it in a session of its own that holds
the given tables as views and no functions of the caller's, and the resolved plan is checked
again: whatever a name was resolved to must be a function of the allowed groups, and whatever
is read must be a given table. The plan that was checked is the one that runs. Errors are
returned as data.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import log_query

MAX_ROWS, TIMEOUT_S = 200, 30.0
# Plan nodes of queries. Whatever else a statement parses to is refused.
PLAN_NODES = set(
    "Aggregate Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range Sample Sort "
    "SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Window WithWindowDefinition "
    "UnresolvedOrdinal AsOfJoin".split()
)
# Groups of built-in functions that compute on their arguments alone, and some of
# the miscellaneous group, whose others call code, read files or tell of the system.
FUNCTION_GROUPS = set(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs "
    "predicate_funcs string_funcs struct_funcs url_funcs window_funcs".split()
)
OTHER_FUNCTIONS, OTHER_PREFIXES = {"typeof", "equal_null"}, ("approx_top_k_", "bitmap_", "hll_", "kll_", "theta_")
# Classes of expressions that no function of these groups is named for. Those of a
# parsed tree, those that hold expressions together, and what some functions are built as.
PARSED = set(
    "Alias AggregateExpression AttributeReference Cube Exists FunctionTableSubqueryArgumentExpression GroupingSets LambdaFunction ListQuery Literal MultiAlias NamePlaceholder NamedArgumentExpression Rollup ScalarSubquery SortOrder "
    "UnresolvedAlias UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedRegex UnresolvedStar "
    "UnresolvedStarExceptOrReplace UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnresolvedOrdinal LateralSubquery InSubquery LikeAll LikeAny NotLikeAll NotLikeAny MultiLikeBase "
    "UnspecifiedFrame SpecifiedWindowFrame UnboundedPreceding UnboundedFollowing CurrentRow WindowExpression WindowSpecDefinition Cast TimestampAdd TimestampDiff Substring StringLocate Overlay "
    "StringTrim StringTrimLeft StringTrimRight UnresolvedTranspose OuterReference TryEval CurrentDate CurrentTimestamp CurrentTime LocalTimestamp IsUnknown IsNotUnknown SimilarTo".split()
)
RESOLVED = PARSED | set(
    "BinaryPad BinaryPredicate Ceil CheckOverflow Collate CommonExpressionDef CommonExpressionRef Contains CountMinSketchAgg DateAddYMInterval DateAddInterval EndsWith Explode Floor "
    "GetArrayItem GetArrayStructFields GetMapValue GetStructField Hour Inline KnownNullable MakeTimestamp MakeTimestampFromDateTime MakeTimestampNTZ Mask Minute Mode NamedLambdaVariable "
    "PercentileCont PercentileDisc PivotFirst PosExplode PreciseTimestampConversion ResolvedCollation RoundCeil RoundFloor Second StartsWith StringLPad StringRPad SubtractDates SubtractTimestamps "
    "TimestampAddInterval TimestampAddYMInterval ToCharacter TryMakeTimestamp TryMakeTimestampFromDateTime With DivideDTInterval DivideYMInterval MultiplyDTInterval MultiplyYMInterval "
    "GeneratorOuter UserDefinedGenerator GroupingID Grouping UpCast".split()
) - {"UserDefinedGenerator"}
# Nodes of analysed queries, and those that read what the statement itself holds.
ANALYSED = set(
    "Aggregate CTERelationDef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit Offset Pivot Project Sample Sort SubqueryAlias Tail Union "
    "Unpivot Window WithCTE AsOfJoin".split()
)
OWN_ROWS = {"CTERelationRef", "LocalRelation", "OneRowRelation", "Range", "ResolvedInlineTable"}
#: Settings that the own session takes over.
SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled")
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack"}


class Refused(ValueError):
    """A statement that may not run, and why."""


@dataclass
class Result:
    """Columns and at most ``MAX_ROWS`` rows, the true number of rows, or an error."""

    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    row_count: int = 0
    seconds: float = 0.0
    error: str | None = None


def _scoped(plan, visible: frozenset[str]) -> list:
    """The plan, its inputs, the queries it names and those inside its expressions, each with the names it may use.

    A named query is visible to those named after it and to the statement, not to itself.
    """
    out, todo = [], [(plan, visible)]
    while todo:
        node, names = todo.pop()
        out.append((node, names))
        children = node.children()
        inner = names
        if node.getClass().getSimpleName() == "UnresolvedWith":
            named = node.cteRelations()
            for i in range(named.size()):
                todo.append((named.apply(i)._2(), inner))
                inner = inner | {named.apply(i)._1().lower()}
        todo += [(children.apply(i), inner) for i in range(children.size())]
        todo += [(e.plan(), names) for e in _expressions(node) if _holds_query(e)]
    return out


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _holds_query(expression) -> bool:
    """Whether an expression holds a query of its own."""
    return _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


def _expressions(plan) -> list:
    """All expressions of one plan node."""
    found = plan.expressions()
    out, todo = [], [found.apply(i) for i in range(found.size())]
    while todo:
        node = todo.pop()
        out.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def _parts(names) -> list[str]:
    return [names.apply(i) for i in range(names.size())]


def _allowed_function(spark: SparkSession, name: list[str]) -> bool:
    """Whether a function is built in and computes on its arguments alone."""
    if len(name) != 1:
        return False
    jvm = spark._jvm
    known = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[0]))
    return known.isDefined() and _pure(known.get())


def _pure(about) -> bool:
    """Whether Spark's own description of a function puts it in the allowed groups, or it is named above."""
    return about.getGroup() in FUNCTION_GROUPS or about.getName() in OTHER_FUNCTIONS or about.getName().startswith(OTHER_PREFIXES)


_CLASSES: dict[bool, set[str]] = {}


def _classes(spark: SparkSession) -> set[str]:
    """Classes that the allowed functions are named for, less those that a refused one shares."""
    if True not in _CLASSES:
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        found = {True: set(), False: set()}
        for name in _parts(registry.listFunction()):
            about = registry.lookupFunction(name).get()
            found[_pure(about)].add(about.getClassName().rpartition(".")[2])
        _CLASSES[True] = found[True] - found[False]
    return _CLASSES[True]


def _check_functions(spark: SparkSession, expressions: list) -> None:
    """Parsed expressions: classes by the lists above, functions by name."""
    classes = _classes(spark) | PARSED
    for e in expressions:
        kind = _kind(e)
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = _parts(e.nameParts() if kind == "UnresolvedFunction" else e.name().nameParts())
            if not _allowed_function(spark, name):
                raise Refused(f"function {'.'.join(name)} is not allowed")
        elif kind not in classes:
            raise Refused(f"{kind} is not allowed")


def _check_resolved(spark: SparkSession, todo: list) -> list:
    """Resolved expressions, by class; returns the queries that they hold.

    Functions that Spark builds from others are judged by themselves and their arguments, not by
    what they are built from.
    """
    classes = _classes(spark) | RESOLVED
    built = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules")
    queries = []
    while todo:
        e = todo.pop()
        if _kind(e) not in classes:
            raise Refused(f"{e.prettyName()} is not allowed")
        if _holds_query(e):
            queries.append(e.plan())
        todo += _parts(e.parameters() if built.isInstance(e) else e.children())
    return queries


def _check_analysed(spark: SparkSession, plan, visible: set[str]) -> None:
    """The resolved plan: what it reads are the given tables and rows of its own, what it computes is allowed."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = _kind(node)
        if kind == "View":
            if not node.isTempView() or node.desc().identifier().table().lower() not in visible:
                raise Refused(f"table {node.desc().identifier().table()} is not allowed")
            continue  # the caller's own plan
        if kind not in ANALYSED | OWN_ROWS:
            raise Refused(f"{kind} is not allowed")
        todo += _parts(node.children())
        todo += _check_resolved(spark, _parts(node.expressions()))


def parsed(spark: SparkSession, sql: str, tables: set[str]):
    """The plan of a statement that is one query over ``tables`` alone; raises ``Refused`` for any other.

    Names of common table expressions count as tables where they are visible. Names are
    compared without case.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise Refused("no statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        nodes = _scoped(plan, frozenset(t.lower() for t in tables))
    except Exception as error:  # py4j wraps the parser's errors
        raise Refused(str(error).splitlines()[0]) from None
    for node, visible in nodes:
        kind = _kind(node)
        if kind not in PLAN_NODES:
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            name = _parts(node.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in visible:
                raise Refused(f"table {'.'.join(name)} is not allowed. Available tables: {', '.join(sorted(tables))}")
        if kind == "UnresolvedTableValuedFunction" and ".".join(_parts(node.name())).lower() not in TABLE_FUNCTIONS:
            raise Refused(f"table function {'.'.join(_parts(node.name()))} is not allowed")
        _check_functions(spark, _expressions(node))
    return plan


def _of_rows(session: SparkSession, plan) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def check(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> None:
    """Raise ``Refused`` unless the statement is one query over ``tables`` alone; nothing is run."""
    guarded(spark, sql, tables)


def check_expression(df: DataFrame, text: str) -> Column:
    """A condition or derived value over a table's columns, checked; raises ``Refused`` if it may not run.

    Queries inside it and functions that reach outside are refused, and names that the table lacks.
    """
    spark = df.sparkSession
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as error:
        raise Refused(str(error).splitlines()[0]) from None
    found, todo = [], [tree]
    while todo:
        node = todo.pop()
        found.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if any(_holds_query(e) for e in found):
        raise Refused("a query inside an expression is not allowed")
    _check_functions(spark, found)
    try:
        plan = df.select(F.expr(text))._jdf.queryExecution().analyzed()  # resolves names, runs nothing
    except PySparkException as error:
        raise Refused(str(error).splitlines()[0]) from None
    # Aggregates, windows and generators have nodes of their own; what lies below is the caller's.
    own = df._jdf.queryExecution().analyzed()
    while not plan.fastEquals(own) and _kind(plan) in ANALYSED:
        _check_resolved(spark, _parts(plan.expressions()))
        plan = plan.children().apply(0)
    return F.expr(text)


def own_session(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A new session with the given tables as views: no other table, no function of the caller's."""
    session = spark.newSession()
    for name in SETTINGS:
        session.conf.set(name, spark.conf.get(name))
    for name, df in tables.items():
        _of_rows(session, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return session


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a checked query over the given tables, lazily: the checked plan itself is run."""
    plan = parsed(spark, sql, set(tables))
    session = own_session(spark, tables)
    try:
        resolved = _of_rows(session, plan)._jdf.queryExecution().analyzed()
    except PySparkException as error:
        raise Refused(str(error).splitlines()[0]) from None
    _check_analysed(session, resolved, {t.lower() for t in tables})
    return _of_rows(session, resolved)


def execute(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int = MAX_ROWS, timeout: float = TIMEOUT_S, log: str | None = None) -> Result:
    """Run a checked query: capped rows with the true count, a time limit, errors as data; with ``log``, each is appended to the log in that folder."""
    found = _executed(spark, sql, tables, max_rows, timeout)
    if log is not None:
        log_query(spark, log, sql, found.row_count, found.seconds, found.error, found.columns, found.rows)
    return found


def _executed(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int, timeout: float) -> Result:
    tag, began = f"guarded-{threading.get_ident()}-{time.monotonic_ns()}", time.monotonic()
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    try:
        timer.start()
        df = guarded(spark, sql, tables)
        rows = df.limit(max_rows + 1).collect()
        count = len(rows) if len(rows) <= max_rows else df.count()
        return Result(df.columns, [list(r) for r in rows[:max_rows]], count, time.monotonic() - began)
    except (Refused, PySparkException, Py4JJavaError) as error:
        return Result(seconds=time.monotonic() - began, error=str(error).splitlines()[0])
    finally:
        timer.cancel()
        spark.removeTag(tag)

"""Read-only check over Spark's own parser output (no SQL parser of our own).

``parse`` returns Spark's unresolved logical plan without running anything. The check walks
every node -- children, CTE bodies and subquery expressions -- against an allow-list of
read-only node classes, and collects the relations a query reads. ``spark.sql`` runs commands
eagerly, so this must happen before the text ever reaches ``spark.sql``.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

# Read-only logical plan nodes accepted anywhere in a query.
READ_NODES = frozenset({
    "Project", "Filter", "Aggregate", "Join", "Union", "Intersect", "Except", "Distinct",
    "Deduplicate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "CTERelationRef", "CTERelationDef", "WithCTE",
    "LocalRelation", "OneRowRelation", "UnresolvedInlineTable", "Window", "WithWindowDefinition",
    "UnresolvedWithWindowDefinition", "Generate", "Pivot", "Unpivot", "Sample", "UnresolvedHint",
    "Expand", "LateralJoin", "UnresolvedSubqueryColumnAliases", "RepartitionByExpression",
    "Repartition", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "ResolvedHint",
    "GroupingSets", "LateralSubquery", "UnresolvedHaving", "Subquery",
})
# Plan roots a read may start with.
READ_ROOTS = READ_NODES - {"CTERelationDef"}
# Functions that reach outside the query (JVM reflection).
DENIED_FUNCTIONS = frozenset({"java_method", "reflect", "try_reflect"})


class ReadOnlyViolation(PermissionError):
    """The SQL text is not a single read-only query."""


class ScopeViolation(PermissionError):
    """The query reads a table outside the declared scope."""


def parse(spark: SparkSession, sql: str):
    """Spark's unresolved plan for ``sql`` (JVM object); any parse failure is a violation."""
    if not sql or not sql.strip():
        raise ReadOnlyViolation("empty SQL text")
    try:
        parser = spark._jsparkSession.sessionState().sqlParser()
        return parser.parsePlan(sql)
    except Exception as exc:  # noqa: BLE001 -- any parse error rejects the text
        raise ReadOnlyViolation(f"could not parse SQL: {str(exc).splitlines()[0]}") from exc


def _seq(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expressions(node) -> None:
    stack = _seq(node.expressions())
    while stack:
        e = stack.pop()
        if _name(e) == "UnresolvedFunction":
            fname = ".".join(_seq(e.nameParts())).lower()
            if fname.split(".")[-1] in DENIED_FUNCTIONS:
                raise ReadOnlyViolation(f"function {fname!r} is not allowed")
        stack.extend(_seq(e.children()))


def walk(plan) -> tuple[set[str], bool]:
    """(tables read, uses a table-valued function); raises on a node that is not read-only.

    A CTE name hides a table only where SQL lets it: in later CTEs of the same WITH and in its
    body, with all that is nested there; in its own definition only if the WITH is recursive."""
    root = _name(plan)
    if root not in READ_ROOTS:
        raise ReadOnlyViolation(f"only read-only queries are allowed (got {root})")
    tables: set[str] = set()
    tvf = False
    stack: list[tuple[Any, frozenset[str]]] = [(plan, frozenset())]
    while stack:
        node, hidden = stack.pop()
        kind = _name(node)
        if kind not in READ_NODES:
            raise ReadOnlyViolation(f"statement node {kind} is not read-only")
        _check_expressions(node)
        if kind == "UnresolvedRelation":
            name = ".".join(_seq(node.multipartIdentifier())).lower()
            if name not in hidden:
                tables.add(name)
        elif kind == "UnresolvedTableValuedFunction":
            tvf = True
        elif kind == "UnresolvedWith":
            for cte in _seq(node.cteRelations()):
                own = str(cte._1()).lower()
                stack.append((cte._2(), hidden | {own} if node.allowRecursion() else hidden))
                hidden = hidden | {own}
        stack.extend((x, hidden) for x in [*_seq(node.children()), *_seq(node.subqueries())])
    return tables, tvf


def audit_target(spark: SparkSession, sql: str) -> str:
    """Best-effort first table name for the audit row, also for statements that are refused."""
    try:
        plan = parse(spark, sql)
    except ReadOnlyViolation:
        return ""
    names: set[str] = set()
    stack = [plan]
    while stack:
        node = stack.pop()
        kind = _name(node)
        if kind in ("UnresolvedRelation", "UnresolvedIdentifier", "UnresolvedTableOrView", "UnresolvedTable"):
            for attr in ("multipartIdentifier", "nameParts"):
                if hasattr(node, attr):
                    try:
                        names.add(".".join(_seq(getattr(node, attr)())).lower())
                        break
                    except Exception:  # noqa: BLE001 -- best effort
                        continue
        try:
            stack.extend(_seq(node.children()))
        except Exception:  # noqa: BLE001
            pass
    return sorted(names)[0] if names else ""


def assert_read_only(spark: SparkSession, sql: str) -> None:
    walk(parse(spark, sql))


def tables_referenced(spark: SparkSession, sql: str) -> set[str]:
    """Lower-cased names of the real tables read."""
    return walk(parse(spark, sql))[0]


def check_scope(spark: SparkSession, sql: str, allowed: list[str]) -> set[str]:
    """Raise ``ScopeViolation`` unless every table read is declared (exact, case-insensitive;
    bare and qualified names never match each other). Empty ``allowed`` means unscoped."""
    read, tvf = walk(parse(spark, sql))
    if not allowed:
        return read
    declared = {a.lower() for a in allowed}
    if tvf:
        raise ScopeViolation("table-valued functions read outside the declared scope")
    for t in sorted(read):
        if t not in declared:
            raise ScopeViolation(f"query reads {t!r}, outside the declared scope {sorted(declared)}")
    return read


_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def check_identifier(name: str) -> str:
    """A plain identifier, or one ``schema.table`` dot; anything else is refused."""
    parts = name.split(".")
    if len(parts) > 2 or not all(_IDENT.match(p) for p in parts):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name

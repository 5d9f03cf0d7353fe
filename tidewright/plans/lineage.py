"""Column lineage of SQL statements, read from Spark's analysed plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def of_frame(df: DataFrame) -> dict[str, list[str]]:
    """For each output column, the columns of base relations (table.column) that it comes from."""
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, set[str] | set[int]] = {}
    base: dict[int, str] = {}

    def visit(node, table: str | None) -> None:
        kind = node.nodeName()
        if kind == "SubqueryAlias":
            table = node.alias() if table is None or not node.child().nodeName().startswith("SubqueryAlias") else table
        kids = node.children()
        for i in range(kids.size()):
            visit(kids.apply(i), table if kind in ("SubqueryAlias", "View", "Project", "Filter") else None)
        output = node.output()
        if not kids.size():
            for i in range(output.size()):
                a = output.apply(i)
                base[a.exprId().id()] = f"{table or kind}.{a.name()}"
        expressions = node.expressions()
        for i in range(expressions.size()):
            e = expressions.apply(i)
            if e.getClass().getSimpleName() == "Alias":
                refs, found = e.references().toSeq(), set()
                for j in range(refs.size()):
                    found.add(refs.apply(j).exprId().id())
                made.setdefault(e.exprId().id(), set()).update(found)
        if kind == "Union":
            for i in range(output.size()):
                made[output.apply(i).exprId().id()] = {kids.apply(k).output().apply(i).exprId().id() for k in range(kids.size())}

    visit(plan, None)

    def roots(k: int, seen: frozenset = frozenset()) -> set[str]:
        if k in base or k in seen:
            return {base[k]} if k in base else set()
        return set().union(*(roots(r, seen | {k}) for r in made.get(k, ())))

    output = plan.output()
    return {output.apply(i).name(): sorted(roots(output.apply(i).exprId().id())) for i in range(output.size())}


def of_sql(spark: SparkSession, statements: dict[str, str]) -> dict[str, dict[str, list[str]]]:
    """Lineage of named statements (SELECT, CREATE TABLE AS, CREATE VIEW AS, INSERT ... SELECT), in the order in which they depend on one another.

    Each becomes a temporary view for those that read it; the views are dropped at the end.
    """
    left, out = dict(statements), {}
    query = {n: re.sub(r"(?is)^\s*(create\s+(or\s+replace\s+)?(temp(orary)?\s+)?(table|view)\s+\S+\s+as|insert\s+into\s+\S+(\s*\([^)]*\))?)\s+(?=select|with)", "", s).rstrip("; \n") for n, s in statements.items()}
    while left:
        ready = [n for n in left if not any(m != n and re.search(rf"(?i)\b{re.escape(m)}\b", query[n]) for m in left)]
        if not ready:
            raise ValueError(f"statements depend on one another in a circle: {sorted(left)}")
        for n in ready:
            df = spark.sql(query[n])
            out[n] = of_frame(df)
            df.createOrReplaceTempView(n)
            del left[n]
    for n in out:
        spark.catalog.dropTempView(n)
    return out

"""Declared table rules as a report: NOT NULL, unique keys, foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revq.session import materialise

# Rows whose keys one task counts: about 200 MB of its memory.
KEYS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class TableRules:
    """Rules of one table; `foreign` maps a column to (table, its column)."""

    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    foreign: Mapping[str, tuple[str, str]] | None = None


def _long(counts: DataFrame, table: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    """One row of counts c0, c1, ... -> one row per (rule, columns)."""
    entries = [
        F.struct(F.lit(rule).alias("rule"), F.lit(columns).alias("columns"), F.col(f"c{i}").alias("violations"))
        for i, (rule, columns) in enumerate(names)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select(
        F.lit(table).alias("table_name"),
        "e.rule",
        "e.columns",
        F.coalesce("e.violations", F.lit(0)).cast("bigint").alias("violations"),
    )


def table_violations(
    tables: Mapping[str, DataFrame],
    table: str,
    rule: TableRules,
    counted: Column | None = None,
    more: Mapping[tuple[str, str], Column] | None = None,
) -> DataFrame:
    """The rules of one table, in one pass over it for all rules.

    The pass writes the unique keys and what each row breaks. Parents are joined by their
    distinct keys. Keys are counted in as many tasks as there are millions of rows, so a
    task's memory does not grow with the table. `counted` limits the rules to some rows;
    `more` names further conditions to count, over all rows.
    """
    counted = F.lit(True) if counted is None else counted
    df = tables[table]
    flags = {("not null", c): counted & F.col(c).isNull() for c in rule.not_null}
    for i, (column, (parent, key)) in enumerate((rule.foreign or {}).items()):
        parents = tables[parent].select(F.col(key).alias(f"_parent{i}")).dropna().distinct()
        df = df.join(parents, F.col(column) == F.col(f"_parent{i}"), "left")
        flags["foreign key", column] = counted & F.col(column).isNotNull() & F.col(f"_parent{i}").isNull()
    flags |= more or {}
    keys = [list(key) for key in rule.unique]
    columns = dict.fromkeys(column for key in keys for column in key)
    broken = {f"f{i}": flag for i, flag in enumerate(flags.values())}
    rows = df.select(*columns, counted.alias("_counted"), *[flag.alias(name) for name, flag in broken.items()])
    rows = materialise(rows)
    parts = []
    if flags:
        sums = rows.agg(*[F.count_if(f).alias(f"c{i}") for i, f in enumerate(broken)])
        parts.append(_long(sums, table, [*flags]))
    tasks = -(-rows.count() // KEYS_PER_TASK) or 1 if keys else 0
    for key in keys:
        whole = rows.where("_counted").select(*key).dropna()
        sizes = whole.repartition(tasks, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_long(sizes.agg(F.count_if(F.col("n") > 1).alias("c0")), table, [("unique", ", ".join(key))]))
    return reduce(DataFrame.unionAll, parts)


def violations(tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules]) -> DataFrame:
    """One row per rule: table_name, rule, columns, violations."""
    return reduce(DataFrame.unionAll, [table_violations(tables, t, r) for t, r in rules.items()])


def enforce(report: DataFrame) -> None:
    """Raise ValueError if any rule of a violations report is broken."""
    broken = report.where("violations > 0").orderBy("table_name", "rule", "columns").collect()
    if broken:
        text = "; ".join(f"{r.table_name} {r.rule} ({r['columns']}): {r.violations}" for r in broken)
        raise ValueError(f"constraints violated: {text}")

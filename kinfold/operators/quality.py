"""Data-quality rules: violations are counted in one pass for each table, keys by anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Table -> rule -> condition that a good row meets (null counts as met, as in a CHECK constraint).
CHECKS: dict[str, dict[str, str]] = {
    "project": {"dates": "end_date is null or end_date >= start_date", "status": "status in ('planned', 'active', 'on_hold', 'completed')"},
    "assignment": {"allocation": "allocation_pct between 1 and 100", "dates": "date_to is null or date_to >= date_from"},
    "resume": {"experience": "total_experience_years >= 0"},
    "competency": {"category": "category in ('hard', 'tool', 'soft')"},
    "person_competency": {"level": "level between 1 and 5"},
    "compensation": {"quarter": "period_quarter between 1 and 4", "amounts": "salary >= 0 and bonus >= 0"},
    "dim_person": {"names": "last_name is not null and first_name is not null", "present": "in_src_projects = 1 or in_src_hr = 1"},
    "dim_person_alias": {"score": "match_score between 0 and 1"},
    "fact_compensation": {"total": "total_pay = salary + bonus"},
}

UNIQUE: dict[str, list[tuple[str, ...]]] = {
    "employee": [("emp_id",)], "role": [("role_name",)], "project": [("project_name",)], "technology": [("tech_name",)], "competency": [("name",)],
    "project_technology": [("project_id", "tech_id")], "assignment": [("emp_id", "project_id", "role_id", "date_from")], "compensation": [("person_id", "period_year", "period_quarter")],
    "dim_person": [("match_key",), ("person_sk",)], "dim_person_alias": [("source_id", "source_pk")], "dim_date": [("full_date",)],
    "fact_assignment": [("src_assignment_id",)], "fact_compensation": [("person_sk", "period_year", "period_quarter")], "fact_person_competency": [("person_sk", "competency_sk")],
}

#: (table, column, parent, parent's column)
REFERENCES: list[tuple[str, str, str, str]] = [
    ("project_technology", "project_id", "project", "project_id"), ("project_technology", "tech_id", "technology", "tech_id"), ("assignment", "emp_id", "employee", "emp_id"),
    ("assignment", "project_id", "project", "project_id"), ("assignment", "role_id", "role", "role_id"), ("resume", "person_id", "person", "person_id"),
    ("person_competency", "person_id", "person", "person_id"), ("person_competency", "competency_id", "competency", "competency_id"), ("compensation", "person_id", "person", "person_id"),
    ("dim_person_alias", "person_sk", "dim_person", "person_sk"), ("fact_assignment", "person_sk", "dim_person", "person_sk"), ("fact_assignment", "project_sk", "dim_project", "project_sk"),
    ("fact_assignment", "role_sk", "dim_role", "role_sk"), ("fact_assignment", "date_from_key", "dim_date", "date_key"), ("fact_assignment", "date_to_key", "dim_date", "date_key"),
    ("fact_compensation", "person_sk", "dim_person", "person_sk"), ("fact_compensation", "period_start_key", "dim_date", "date_key"), ("fact_person_competency", "person_sk", "dim_person", "person_sk"),
    ("fact_person_competency", "competency_sk", "dim_competency", "competency_sk"), ("bridge_project_technology", "project_sk", "dim_project", "project_sk"), ("bridge_project_technology", "technology_sk", "dim_technology", "technology_sk"),
]


def check_rows(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """(rule, violations) of a table, all rules in one aggregation."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(True))).alias(n) for n, r in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(violations): rows beyond the first of each key; keys with a null are left out, as a unique index does."""
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(full).groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(violations): rows whose key the parent doesn't have."""
    p = parent.select(F.col(key).alias("__key")).distinct()
    return df.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("__key"), "left_anti").agg(F.count("*").alias("violations"))


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, violations) of all rules whose tables are there."""
    out = []
    for t, rules in CHECKS.items():
        if t in tables:
            out.append(check_rows(tables[t], rules).select(F.lit(t).alias("table"), "rule", "violations"))
    for t, keys in UNIQUE.items():
        out += [duplicates(tables[t], k).select(F.lit(t).alias("table"), F.lit("unique " + ", ".join(k)).alias("rule"), "violations") for k in keys if t in tables]
    for t, c, p, k in REFERENCES:
        if t in tables and p in tables:
            out.append(orphans(tables[t], c, tables[p], k).select(F.lit(t).alias("table"), F.lit(f"{c} in {p}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, out)


def gate(tables: dict[str, DataFrame]) -> None:
    """Raises with the rules that any row violates."""
    bad = report(tables).where("violations > 0").collect()  # one row a rule
    if bad:
        raise ValueError("data quality: " + "; ".join(f"{r.table}: {r.rule}: {r.violations}" for r in bad))

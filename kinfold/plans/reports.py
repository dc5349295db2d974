"""The analytic queries over the registries and the warehouse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.warehouse import tech_stack


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, cnt) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("cnt")).select(F.lit(n).alias("tbl"), "cnt") for n, df in tables.items()])


def sample_names(employee: DataFrame, person: DataFrame, n: int = 20) -> DataFrame:
    """First names of both registries by source and id."""
    a = employee.select(F.lit("src_projects").alias("src"), F.col("emp_id").alias("id"), F.col("full_name").alias("raw_fio"))
    b = person.select(F.lit("src_hr"), "person_id", "fio")
    return a.union(b).orderBy("src", "id").limit(n)


def project_stacks(project: DataFrame, project_technology: DataFrame, technology: DataFrame) -> DataFrame:
    return project.join(tech_stack(project_technology, technology), "project_id").select("project_name", "tech_stack")


def pay_by_position(resume: DataFrame, compensation: DataFrame) -> DataFrame:
    """Average monthly salary and quarterly bonus by position; halves round away from zero."""
    j = resume.join(compensation, "person_id").groupBy("position_title")
    return j.agg(F.round(F.avg("salary") / 3).alias("avg_monthly_salary"), F.round(F.avg("bonus")).alias("avg_quarter_bonus")).orderBy(F.desc("avg_monthly_salary"), "position_title")

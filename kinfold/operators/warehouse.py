"""The star schema: calendar, dimensions, bridge, facts, upserts and publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import numbered


def date_key(c: str | Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("long")


def calendar(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31") -> DataFrame:
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    return d.select(
        date_key("full_date").alias("date_key"), "full_date", F.year("full_date").alias("year_num"), F.quarter("full_date").cast("short").alias("quarter_num"), F.month("full_date").cast("short").alias("month_num"),
        F.dayofmonth("full_date").cast("short").alias("day_num"), (F.weekday("full_date") + 1).cast("short").alias("weekday_num"), (F.weekday("full_date") >= 5).cast("int").alias("is_weekend"),
    )


def dimension(df: DataFrame, key: str, surrogate: str, columns: dict[str, str]) -> DataFrame:
    """Rows of a source table under surrogate keys in the order of its key; columns: source name -> name in the dimension."""
    return numbered(df.select(*[F.col(a).alias(b) for a, b in columns.items()]), [columns[key]], surrogate).withColumn(surrogate, F.col(surrogate).cast("int"))


def tech_stack(project_technology: DataFrame, technology: DataFrame) -> DataFrame:
    """(project_id, tech_stack): technologies of a project, core ones first, then by name."""
    j = project_technology.join(technology, "tech_id")
    return j.groupBy("project_id").agg(F.expr("listagg(tech_name, ', ') within group (order by is_core desc, tech_name)").alias("tech_stack"))


def dimensions(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    stack = tech_stack(t["project_technology"], t["technology"])
    same = lambda *names: {n: n for n in names}
    return {
        "dim_role": dimension(t["role"], "role_id", "role_sk", {"role_id": "src_role_id"} | same("role_name", "description")),
        "dim_technology": dimension(t["technology"], "tech_id", "technology_sk", {"tech_id": "src_tech_id"} | same("tech_name", "category")),
        "dim_competency": dimension(t["competency"], "competency_id", "competency_sk", {"competency_id": "src_competency_id"} | same("name", "category")),
        "dim_project": dimension(t["project"].join(stack, "project_id", "left"), "project_id", "project_sk", {"project_id": "src_project_id"} | same("project_name", "customer", "description", "tech_stack", "start_date", "end_date", "status")),
    }


def bridge_project_technology(t: dict[str, DataFrame], d: dict[str, DataFrame]) -> DataFrame:
    p = d["dim_project"].select("project_sk", F.col("src_project_id").alias("project_id"))
    q = d["dim_technology"].select("technology_sk", F.col("src_tech_id").alias("tech_id"))
    return t["project_technology"].join(p, "project_id").join(q, "tech_id").select("project_sk", "technology_sk", "is_core")


def _persons(aliases: DataFrame, source: int, key: str) -> DataFrame:
    return aliases.where(F.col("source_id") == source).select(F.col("source_pk").alias(key), "person_sk")


def fact_assignment(t: dict[str, DataFrame], d: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """Assignments of resolved persons; an open end has no key."""
    p = d["dim_project"].select("project_sk", F.col("src_project_id").alias("project_id"))
    r = d["dim_role"].select("role_sk", F.col("src_role_id").alias("role_id"))
    a = t["assignment"].join(_persons(aliases, 1, "emp_id"), "emp_id").join(p, "project_id").join(r, "role_id")
    a = a.select(F.col("assignment_id").alias("src_assignment_id"), "person_sk", "project_sk", "role_sk", date_key("date_from").alias("date_from_key"), date_key("date_to").alias("date_to_key"), "allocation_pct")
    return numbered(a, ["src_assignment_id"], "assignment_sk")


def fact_compensation(t: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """Pay by person and quarter.  Where two source persons are one, the larger pay of a quarter stands (the grain allows one row)."""
    c = t["compensation"].join(_persons(aliases, 2, "person_id"), "person_id")
    best = F.max_by(F.struct("salary", "bonus", "currency"), F.struct("salary", "bonus", F.col("comp_id")))
    c = c.groupBy("person_sk", "period_year", "period_quarter").agg(best.alias("x")).select("person_sk", "period_year", "period_quarter", "x.*")
    start = F.make_date("period_year", (F.col("period_quarter").cast("int") - 1) * 3 + 1, F.lit(1))
    c = c.select("person_sk", date_key(start).alias("period_start_key"), "period_year", "period_quarter", "salary", "bonus", (F.col("salary") + F.col("bonus")).cast("decimal(13,2)").alias("total_pay"), "currency")
    return numbered(c, ["person_sk", "period_start_key"], "comp_sk")


def fact_person_competency(t: dict[str, DataFrame], d: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """Competencies of persons; of several source rows the highest level and the most years stand."""
    c = d["dim_competency"].select("competency_sk", F.col("src_competency_id").alias("competency_id"))
    j = t["person_competency"].join(_persons(aliases, 2, "person_id"), "person_id").join(c, "competency_id")
    return j.groupBy("person_sk", "competency_sk").agg(F.max("level").alias("level"), F.max("years_exp").alias("years_exp"))


def dim_person_resume(t: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """One resume a person: the latest, then the larger source key."""
    r = t["resume"].join(_persons(aliases, 2, "person_id"), "person_id")
    latest = F.max_by(F.struct("position_title", "total_experience_years", "education", "summary", "updated_at"), F.struct("updated_at", "person_id"))
    return r.groupBy("person_sk").agg(latest.alias("x")).select("person_sk", "x.*")


def unresolved(t: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """(fact, n_rows, persons): source rows of each fact whose person is in review, so that no person_sk stands for them yet.  They enter
    the facts with the run after the steward's decision; until then this table accounts for them."""
    out = None
    for fact, name, source, key in (("fact_assignment", "assignment", 1, "emp_id"), ("fact_compensation", "compensation", 2, "person_id"), ("fact_person_competency", "person_competency", 2, "person_id"), ("dim_person_resume", "resume", 2, "person_id")):
        gone = t[name].join(_persons(aliases, source, key), key, "left_anti")
        row = gone.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("persons")).select(F.lit(fact).alias("fact"), "n_rows", "persons")
        out = row if out is None else out.unionByName(row)
    return out


def pay_and_load(assignments: DataFrame, pay: DataFrame) -> DataFrame:
    """Assignments and pay by person; each fact is brought to the person's grain before they meet."""
    a = assignments.groupBy("person_sk").agg(F.count("*").alias("assignments"), F.sum("allocation_pct").alias("allocation_pct"))
    c = pay.groupBy("person_sk").agg(F.avg("total_pay").alias("avg_quarter_pay"), F.sum("total_pay").alias("total_pay"))
    return a.join(c, "person_sk")


# ---- upserts -------------------------------------------------------------------------------------------------


def upsert_persons(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """dim_person with the persons of a run (gid, names, match_key, presence) merged in by match_key.

    A person there already keeps person_sk and the names first inserted, takes the new canonical_fio, and is present where it was or is
    found now.  Of new persons with one key, names come from the first by gid and canonical_fio from the last.
    """
    n = new.groupBy("match_key").agg(
        F.min("gid").alias("gid"), *[F.min_by(F.struct(c), F.struct("gid")).alias(c) for c in ("last_name", "first_name", "middle_name")],
        F.max_by("canonical_fio", "gid").alias("canonical_fio"), F.max("in_src_projects").alias("in_src_projects"), F.max("in_src_hr").alias("in_src_hr"),
    )
    n = n.select("match_key", "gid", *[F.col(c)[c].alias(c) for c in ("last_name", "first_name", "middle_name")], "canonical_fio", "in_src_projects", "in_src_hr")
    names = ("last_name", "first_name", "middle_name")
    cols = ["person_sk", "canonical_fio", *names, "match_key", "in_src_projects", "in_src_hr"]
    if old is None:
        return numbered(n, ["gid"], "person_sk").select(*cols)
    o, m = old.alias("o"), n.alias("n")
    here = F.col("o.person_sk").isNotNull()
    j = o.join(m, F.col("o.match_key") == F.col("n.match_key"), "full").select(
        "o.person_sk", F.coalesce("n.canonical_fio", "o.canonical_fio").alias("canonical_fio"), *[F.when(here, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in names],
        F.coalesce("o.match_key", "n.match_key").alias("match_key"),
        *[F.greatest(F.coalesce(f"o.{c}", F.lit(0)), F.coalesce(f"n.{c}", F.lit(0))).alias(c) for c in ("in_src_projects", "in_src_hr")], "n.gid",
    )
    top = old.agg(F.coalesce(F.max("person_sk"), F.lit(0)).alias("top"))
    fresh = numbered(j.where("person_sk is null").drop("person_sk"), ["gid"], "i").join(F.broadcast(top)).withColumn("person_sk", F.col("top") + F.col("i"))
    return j.where("person_sk is not null").select(*cols).unionByName(fresh.select(*cols))


def upsert_aliases(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """dim_person_alias merged by (source_id, source_pk): a record there already takes the new method and score and keeps its person and raw name."""
    cols = ["person_sk", "source_id", "source_pk", "raw_fio", "match_method", "match_score"]
    n = new.groupBy("source_id", "source_pk").agg(F.min_by(F.struct("person_sk", "raw_fio"), F.struct("seq")).alias("a"), F.max_by(F.struct("match_method", "match_score"), F.struct("seq")).alias("b"))
    n = n.select("a.person_sk", "source_id", "source_pk", "a.raw_fio", "b.match_method", "b.match_score")
    if old is None:
        return numbered(n, ["source_id", "source_pk"], "alias_id").select("alias_id", *cols)
    o, m = old.alias("o"), n.alias("n")
    on = (F.col("o.source_id") == F.col("n.source_id")) & (F.col("o.source_pk") == F.col("n.source_pk"))
    j = o.join(m, on, "full").select(
        "o.alias_id", *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in cols[:4]], F.coalesce("n.match_method", "o.match_method").alias("match_method"), F.coalesce("n.match_score", "o.match_score").alias("match_score")
    )
    top = old.agg(F.coalesce(F.max("alias_id"), F.lit(0)).alias("top"))
    fresh = numbered(j.where("alias_id is null").drop("alias_id"), ["source_id", "source_pk"], "i").join(F.broadcast(top)).withColumn("alias_id", F.col("top") + F.col("i"))
    return j.where("alias_id is not null").select("alias_id", *cols).unionByName(fresh.select("alias_id", *cols))


def review_queue(review: DataFrame, persons_of: DataFrame) -> DataFrame:
    """Records for a steward, the candidate as person_sk (persons_of: gid, person_sk)."""
    j = review.join(persons_of, review.candidate_gid == persons_of.gid, "left")
    j = j.select("source_id", "source_pk", "raw_fio", F.col("person_sk").alias("candidate_person_sk"), "match_score", "reason", F.lit("new").alias("status"))
    return numbered(j, ["source_id", "source_pk"], "review_id")


def apply_reviews(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue with the steward's decisions (review_id, approved) as status, and the aliases that approval gives (method manual)."""
    j = queue.join(decisions, "review_id", "left").withColumn("status", F.when(F.col("approved"), F.lit("approved")).when(~F.col("approved"), F.lit("rejected")).otherwise(F.col("status"))).drop("approved")
    ok = j.where("status = 'approved' and candidate_person_sk is not null")
    return j, ok.select(F.col("candidate_person_sk").alias("person_sk"), "source_id", "source_pk", "raw_fio", F.lit("manual").alias("match_method"), "match_score", F.col("review_id").alias("seq"))


# ---- publication ---------------------------------------------------------------------------------------------


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], check) -> str:
    """Write all tables to a new run folder, check them, then make the pointer file name it: readers see all tables of a run or
    none.  check(tables read back) raises to keep the old state.  Returns the run's folder."""
    run = f"{root}/run-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{run}/{name}")
    check({name: spark.read.parquet(f"{run}/{name}") for name in tables})
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.new"), True)
    out.write(bytearray(json.dumps({"run": run}).encode()))
    out.close()
    fs.delete(path, False)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.new"), path)
    return run


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the published run; one that was being switched when the job died counts as published."""
    for name in ("CURRENT", "CURRENT.new"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return json.loads(spark.read.text(f"{root}/{name}").first()[0])["run"]
    return None


def save_catalog(spark: SparkSession, database: str, tables: dict[str, DataFrame]) -> None:
    """The tables as managed tables of a database made anew: what it held before is dropped."""
    spark.sql(f"drop database if exists `{database}` cascade")
    spark.sql(f"create database `{database}`")
    for name, df in tables.items():
        df.write.format("parquet").saveAsTable(f"`{database}`.`{name}`")

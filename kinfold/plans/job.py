"""The batch job: registries in, resolved persons and star schema out, published as a whole."""

from __future__ import annotations

import datetime
import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import quality, warehouse as W
from ..operators.resolve import Rules, resolve_records
from ..operators.shared import checkpointed
from ..sources.tables import person_records, sources

log = logging.getLogger(__name__)
RUN = "run_id string, started_at timestamp, finished_at timestamp, status string, persons_matched long, persons_created long, persons_review long, message string"


def build(spark: SparkSession, t: dict[str, DataFrame], rules: Rules = Rules(), old: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of the warehouse from those of the sources; old: dim_person and dim_person_alias to merge into."""
    old = old or {}
    persons, aliases, review = resolve_records(person_records(t["employee"], t["person"]), rules)
    persons, aliases, review = map(checkpointed, (persons, aliases, review))
    dim_person = checkpointed(W.upsert_persons(old.get("dim_person"), persons))
    of = persons.select("gid", "match_key").join(dim_person.select("match_key", "person_sk"), "match_key").select("gid", "person_sk")
    alias = checkpointed(W.upsert_aliases(old.get("dim_person_alias"), aliases.join(of, "gid")))
    out = {"dim_source": sources(spark), "dim_date": W.calendar(spark), "dim_person": dim_person, "dim_person_alias": alias, "etl_review_queue": W.review_queue(review, of)}
    if "project" in t:
        d = {k: checkpointed(v) for k, v in W.dimensions(t).items()}
        out |= d | {
            "bridge_project_technology": W.bridge_project_technology(t, d), "fact_assignment": W.fact_assignment(t, d, alias), "fact_compensation": W.fact_compensation(t, alias),
            "fact_person_competency": W.fact_person_competency(t, d, alias), "dim_person_resume": W.dim_person_resume(t, alias), "etl_unresolved": W.unresolved(t, alias),
        }
    return out


def run(spark: SparkSession, t: dict[str, DataFrame], root: str, rules: Rules = Rules()) -> str:
    """Build, check and publish; the run log gets a row either way.  Returns the folder of the published run; errors are raised."""
    started, at = datetime.datetime.now(datetime.UTC).replace(tzinfo=None), W.current(spark, root)
    old = {k: spark.read.parquet(f"{at}/{k}") for k in ("dim_person", "dim_person_alias")} if at else None
    note = {"status": "failed", "matched": 0, "created": 0, "review": 0, "message": None}
    try:
        quality.gate(t)
        out = build(spark, t, rules, old)
        where = W.publish(spark, root, out, quality.gate)
        a = spark.read.parquet(f"{where}/dim_person_alias").agg(F.count_if(F.col("match_method") != "new").alias("m"), F.count_if(F.col("match_method") == "new").alias("c")).first()
        note |= {"status": "success", "matched": a.m, "created": a.c, "review": spark.read.parquet(f"{where}/etl_review_queue").count()}
        return where
    except Exception as e:
        note["message"] = str(e)[:1000]
        raise
    finally:
        row = (started.strftime("%Y%m%dT%H%M%S%f"), started, datetime.datetime.now(datetime.UTC).replace(tzinfo=None), note["status"], note["matched"], note["created"], note["review"], note["message"])
        spark.createDataFrame([row], RUN).write.mode("append").parquet(f"{root}/etl_run_log")
        log.info("run %s: %s", row[0], note)

"""How well links agree with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def truth_records(truth: DataFrame) -> DataFrame:
    """(source_id, source_pk, true_id) of the file of true persons."""
    one = lambda s, c: truth.where(F.col(c).isNotNull()).select(F.lit(s).alias("source_id"), F.col(c).cast("long").alias("source_pk"), "true_id")
    return one(1, "src_projects_emp_id").unionByName(one(2, "src_hr_person_id"))


def pairwise(aliases: DataFrame, truth: DataFrame, person: str = "person_sk") -> DataFrame:
    """One row: pairs that are linked and true, linked, and true, with precision, recall and F1.

    Counted from cluster sizes (n * (n - 1) / 2), so no pairs are made.  Records that are in no cluster (in review) link with nothing.
    """
    r = truth.join(aliases.select("source_id", "source_pk", F.col(person).alias("p")), ["source_id", "source_pk"], "left")
    pairs = lambda df, *keys: df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("n"))
    known = r.where("p is not null")
    both = pairs(known, "true_id", "p").select(F.col("n").alias("both"))
    x = both.join(pairs(known, "p").select(F.col("n").alias("linked"))).join(pairs(r, "true_id").select(F.col("n").alias("true")))  # one row each
    p, q = F.col("both") / F.nullif("linked", F.lit(0)), F.col("both") / F.nullif("true", F.lit(0))
    return x.select("both", "linked", "true", p.alias("precision"), q.alias("recall"), (2 * p * q / F.nullif(p + q, F.lit(0.0))).alias("f1"))

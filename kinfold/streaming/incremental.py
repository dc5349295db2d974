"""Records that arrive as a stream, resolved batch by batch against the persons already published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import warehouse as W
from ..operators.resolve import Rules, resolve_records


def attach(spark: SparkSession, root: str, rules: Rules = Rules()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch of records (source_id, source_name, source_pk, fio) is resolved together with all records
    published before (they come first, so persons keep their founders) and published anew.  A batch that is run again after a
    failure gives the same tables, as records are merged by their key."""

    def run(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        at = W.current(s, root)
        old = {k: s.read.parquet(f"{at}/{k}") for k in ("dim_person", "dim_person_alias", "records")} if at else {}
        new = batch.select("source_id", "source_name", "source_pk", "fio").dropDuplicates(["source_id", "source_pk"])
        if old:
            new = old["records"].unionByName(new.join(old["records"], ["source_id", "source_pk"], "left_anti"))
        persons, aliases, review = resolve_records(new, rules)
        dim = W.upsert_persons(old.get("dim_person"), persons)
        of = persons.select("gid", "match_key").join(dim.select("match_key", "person_sk"), "match_key").select("gid", "person_sk")
        W.publish(s, root, {"dim_person": dim, "dim_person_alias": W.upsert_aliases(old.get("dim_person_alias"), aliases.join(of, "gid")), "etl_review_queue": W.review_queue(review, of), "records": new}, lambda t: None)

    return run


def start(stream: DataFrame, root: str, checkpoint: str, rules: Rules = Rules(), **trigger) -> StreamingQuery:
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(attach(spark, root, rules)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

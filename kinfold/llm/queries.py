"""Queries over the corpus tables, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on documents outside the held-out third; every document is predicted from its text alone."""
    from .languages import fit, identify

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = identify(docs.select("doc_id", "text"), fit(docs.where(~held).select("doc_id", "text", "lang")))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so each vector of embeddings is drawn as one; edited copies of those whose id 50 divides are
    searched for among all."""
    from .images import find_copies, pictures

    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", "embedding")
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # drawing costs far more than moving the vectors
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return find_copies(pictures(rows.where("vec_id % 50 = 0"), change=True), pictures(rows))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unit_dedup import remove_repeated_units

    out = remove_repeated_units(table(spark, sf_dir, "documents"))
    first = F.when(F.size("__spans") > 0, F.element_at("__spans", 1)["start"]).otherwise(-1)
    return out.select("doc_id", F.col("__units").alias("n_units"), F.col("__removed").alias("n_removed"), first.alias("first_removed"), "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import drop_repeated_runs

    out = drop_repeated_runs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.size("__spans").cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .blocks import release
    from .kneser_ney import classify

    per, stored, _ = classify(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    release(stored)
    return per.select("doc_id", "lang", F.col("n").alias("n_symbols"), "perplexity", "bound", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_near_duplicates, op4_media, op5_fingerprints, op6_repeats, op7_unit_dedup, op8_line_dedup, op9_quality, op10_mixing)}

#: Equivalents for DuckDB where SQL can state the operator; tests/llm holds the others against brute force.
ORACLE: dict[str, str] = {
    "op7_unit_dedup": r"""
with t as (
    select doc_id, text, length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as toks
    from documents where doc_id is not null
), w as (
    select doc_id, lead, unnest(toks) as tok, generate_subscripts(toks, 1) as i from t
), e as (
    select *, regexp_extract(tok, '^[^\x20\x09-\x0D]+') as word, regexp_extract(tok, '[\x20\x09-\x0D]*$') as white from w
), n as (
    select *, coalesce(sum(cast(contains(white, chr(10)) or white <> '' and regexp_matches(word, '[.!?]$') as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as u,
        lead + coalesce(sum(length(tok)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start
    from e
), g as (
    select doc_id, u, string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' order by i) as unit, count(*) as words, min(start)::bigint as start,
        string_agg(tok, '' order by i) as raw, arg_max(white, i) as white
    from n group by doc_id, u
), f as (
    select unit, min({'d': doc_id, 'u': u}) as first from g where words >= 8 group by unit
), k as (
    select g.*, coalesce({'d': g.doc_id, 'u': g.u} > f.first, false) as gone, lag(white) over (partition by doc_id order by u) as before from g left join f on g.unit = f.unit
), m as (
    select *, row_number() over (partition by doc_id, gone order by u) as r from k
), o as (
    select doc_id, count(*) as n_units, count(*) filter (gone) as n_removed, coalesce(min(start) filter (gone), -1) as first_removed,
        coalesce(string_agg(case when r = 1 then '' else before end || left(raw, length(raw) - length(white)), '' order by u) filter (not gone), '') as text
    from m group by doc_id
)
select t.doc_id, coalesce(n_units, 0) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(first_removed, -1) as first_removed, case when n_removed > 0 then o.text else t.text end as text
from t left join o on t.doc_id = o.doc_id""",
    "op8_line_dedup": """
with l as (
    select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
    from documents where doc_id is not null and text is not null
), w as (
    select doc_id, i, line, lead(line) over (partition by doc_id order by i) as nxt from l
), f as (
    select line, nxt, min({'d': doc_id, 'i': i}) as first from w where nxt is not null group by 1, 2
), c as (
    select w.doc_id, w.i from w join f on w.line = f.line and w.nxt = f.nxt where {'d': w.doc_id, 'i': w.i} > f.first
), g as (
    select distinct doc_id, i from (select doc_id, i from c union all select doc_id, i + 1 from c)
), k as (
    select l.doc_id, l.line, l.i, g.i is not null as gone, g.i is not null and lag(g.i) over (partition by l.doc_id order by l.i) is null as begins
    from l left join g on l.doc_id = g.doc_id and l.i = g.i
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_runs,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from k group by doc_id""",
}

"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogue_lake.llm import gru_lm, hard_negatives, iblt, license_scan, line_crf, mixing, near_dedup, packing, quality_rules, repeated_bytes, secret_scan, spelling, token_counts
from dialogue_lake.llm import textual as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query()
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.measured(documents(spark, folder).select("doc_id", "text"))
    base = quality_rules.base_failed()
    return found.select(
        "doc_id", *[F.col(f"_q_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), (~base & quality_rules.verdict()).alias("kept"))


OP2_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         substr(md5(cast(doc_id as varchar)), 1, 12) as h
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place
  from sized group by source),
weighed as (select *, (place - 1) % 3 + 1 as weight from sources),
steps as (
  select *,
    cast(sum(source_size) over () - coalesce(sum(3 * source_size) over (
      order by source_size / cast(weight as double), place rows between unbounded preceding and 1 preceding), 0) as double) as left_over,
    cast(sum(weight) over (
      order by source_size / cast(weight as double), place rows between current row and unbounded following) as double) as weights
  from weighed),
stops as (select *, 3.0::double * source_size * weights < left_over * weight as stopped,
                 source_size / cast(weight as double) as ratio from steps),
level as (select left_over as l, weights as w, ratio as r, place as p from stops where not stopped order by ratio, place limit 1),
wanted as (
  select source, source_size,
    case when (ratio, place) >= (r, p) then l * weight / w else 3.0::double * source_size end as target
  from stops, level),
budget as (
  select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 3) else 0 end as copies from wanted),
rest as (select *, target - copies * source_size as rest from budget),
ranked as (
  select s.doc_id, s.size, r.source_size, r.target, r.copies, r.rest,
    sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) as upto,
    sum(s.size) over (partition by s.source, s.h) as own
  from sized s join rest r on s.source is not distinct from r.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (copies + case when upto <= rest or (upto - own <= rest and upto - rest < rest - (upto - own)) then 1 else 0 end) as bigint) as taken
from ranked
"""


@query(OP2_SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query()
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = documents(spark, folder).select(
        "doc_id", F.octet_length(tx.whole("text")).cast("long").alias("n_bytes"),
        token_counts.n_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder).select("doc_id", secret_scan.secret_spans(F.col("text")).alias("spans"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x.kind.isin(*secret_scan.KINDS))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query()
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.components_of(documents(spark, folder), words=4)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def remainder(n: int):
    """crc32 of the document id's text, modulo 5, equals ``n``."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == n


@query()
def op4_gru_lm(spark: SparkSession, folder: str) -> DataFrame:
    found = gru_lm.likelihoods(documents(spark, folder), ~remainder(1))
    return found.select("doc_id", remainder(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op3_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~remainder(0))
    found = docs.select("doc_id", remainder(0).alias("held_out"), line_crf.scored(docs, labels).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query()
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(documents(spark, folder))


@query()
def op5_iblt(spark: SparkSession, folder: str) -> DataFrame:
    return iblt.compared(documents(spark, folder))


OP11_SQL = """
with rows_ as (
  select vec_id as id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
once as (
  select id, label, list_resize(q, (select max(len(q)) from rows_), 0.0) as q
  from rows_ qualify row_number() over (partition by id order by label, q) = 1),
scores as (
  select a.id as anchor_id, r.id, r.label = a.label as same, cast(list_inner_product(a.q, r.q) as bigint) as score
  from once a, once r where a.id % 100 = 0 and a.id <> r.id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by n.score desc, n.id) as int) as rank,
  n.id as negative_id, positive_score, n.score as negative_score
from positives join scores n using (anchor_id)
where not n.same and 80 * positive_score <= 100 * n.score and 100 * n.score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by n.score desc, n.id) <= 5
"""


@query(OP11_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.mined(rows)


@query()
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder))


@query()
def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes.deduplicated(documents(spark, folder)).drop("kept")

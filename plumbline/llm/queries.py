"""Queries of the problems p6 to p10 and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.identity import imo_is_valid
from plumbline.llm import components, leakage, mixture, pii, survivor
from plumbline.session import spread
from plumbline.sources.tables import table

#: Folder of the public tokenizers' files; the same on every executor.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that a pair of confidence 0.85 to 1 links, with the least record_id of its group."""
    pairs = table(spark, folder, "entity_matches", "record_a_id", "record_b_id", "confidence_score").where(F.col("confidence_score").between(0.85, 1.0))
    tidy = lambda c: F.upper(F.trim(F.regexp_replace(F.col(c), r"^\s+|\s+$", "")))
    found = components.linked_groups(pairs.select(tidy("record_a_id").alias("a"), tidy("record_b_id").alias("b")), "a", "b")
    return found.select(F.col("node").alias("record_id"), F.col("root").alias("group_root"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Size of each group of linked records."""
    return p6_found(spark, folder).groupBy("group_root").agg(F.count(F.lit(1)).alias("members"))


def _records(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    rows = table(spark, folder, "vessel_records", "record_id", "group_id", "source", "imo", "grossTonnage", "builtYear", "UpdateDate")
    fields = {"imo": imo_is_valid(F.col("imo")), "gross_tonnage": (F.col("grossTonnage") > 0) & (F.col("grossTonnage") <= 300_000), "built_year": F.col("builtYear").between(1900, 2025)}
    return survivor.rated(rows, "source", table(spark, folder, "feeds", "feed_code", "trust_rank"), "feed_code", "trust_rank"), fields


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each reviewed group the records that give imo, gross tonnage and built year."""
    rows, fields = _records(spark, folder)
    return survivor.surviving_fields(rows, "group_id", "record_id", "UpdateDate", fields).select("group_id", "field_name", "record_id")


def p7_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """For each reviewed group the record that the policy picks from its first layer."""
    rows, fields = _records(spark, folder)
    return survivor.survivors(rows, "group_id", "record_id", "UpdateDate", fields)


def p7_golden(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each reviewed group: the policy's pick of the first layer of dominance, with what it lacks filled from
    the layers in turn; null where no record of the group has a good value."""
    rows, fields = _records(spark, folder)
    own = {"imo": "imo", "gross_tonnage": "grossTonnage", "built_year": "builtYear"}
    return survivor.golden(rows, "group_id", "record_id", "UpdateDate", {n: (c, fields[n]) for n, c in own.items()})


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items of which they hold at least 12 words in a row."""
    return _leaked(spark, folder).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """For each leaked item the documents that hold it, how many hold at least half of it, and the largest share held."""
    share = F.col("covered") / F.col("passage_words")
    return _leaked(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(share >= 0.5, 1)).alias("at_least_half"), F.max(share).alias("largest_share"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = spread(table(spark, folder, "documents", "doc_id", "text", "source"), "doc_id"), table(spark, folder, "mixture_targets")
    return mixture.mix(docs, "doc_id", "text", "source", targets, "target_share", "max_repeats", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", each_row=True)


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of tokens that each target source reaches in the mixture."""
    return _mixed(spark, folder)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information in every document, each distinct piece as it is written."""
    return pii.found(spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text")


def p10_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return pii.masked(spread(table(spark, folder, "documents", "doc_id", "text"), "doc_id"), "text")


_ALL = (p6_found, p6_groups, p7_found, p7_golden, p7_survivors, p8_found, p8_coverage, p9_selection, p9_shares, p10_found, p10_masked)

_IMO = "(r.imo between 1000000 and 9999999 and (((r.imo//1000000)%10)*7+((r.imo//100000)%10)*6+((r.imo//10000)%10)*5+((r.imo//1000)%10)*4+((r.imo//100)%10)*3+((r.imo//10)%10)*2)%10=r.imo%10)"

#: Reviewed records with trust, time (nulls last) and good values, and when record a dominates record b.
_RATED_SQL = f"""s as (select r.group_id, r.record_id, coalesce(f.trust_rank, 2147483647) trust, coalesce(r.UpdateDate, timestamp '0001-01-01') moment, case when {_IMO} then r.imo end i, case when r.grossTonnage > 0 and r.grossTonnage <= 300000 then r.grossTonnage end g, case when r.builtYear between 1900 and 2025 then r.builtYear end y
 from vessel_records r left join feeds f on r.source = f.feed_code where r.group_id is not null),
q as (select *, (i is not null)::int + (g is not null)::int + (y is not null)::int complete from s)"""
_DOMINATES = "a.group_id = b.group_id and a.complete >= b.complete and a.trust <= b.trust and a.moment >= b.moment and (a.complete > b.complete or a.trust < b.trust or a.moment > b.moment)"

def _grams_sql(table_: str, key: str) -> str:
    """Each run of 12 words of a table's texts, once a row, in capitals-blind, accent-blind words."""
    plain = "regexp_replace(strip_accents(lower(text)), '[\\p{M}\\p{Cf}]', '', 'g')"
    return f"(select distinct {key}, array_to_string(w[i:i + 11], ' ') g from (select {key}, w, unnest(range(1, len(w) - 10)) i from (select {key}, regexp_extract_all({plain}, '[\\p{{L}}\\p{{Nd}}]+') w from {table_} where text is not null)))"


SQL: dict[str, str] = {
    "p8_found": f"select distinct d.doc_id, e.item_id from {_grams_sql('documents', 'doc_id')} d join {_grams_sql('eval_items', 'item_id')} e using (g)",
    "p6_found": """
with recursive e as (select distinct upper(trim(record_a_id)) a, upper(trim(record_b_id)) b from entity_matches where confidence_score between 0.85 and 1 and upper(trim(record_a_id)) <> upper(trim(record_b_id))),
s as (select a, b from e union select b, a from e),
r(a, b) as (select a, a from s union select r.a, s.b from r join s on r.b = s.a)
select a record_id, min(b) group_root from r group by 1""",
    "p6_groups": """
with recursive e as (select distinct upper(trim(record_a_id)) a, upper(trim(record_b_id)) b from entity_matches where confidence_score between 0.85 and 1 and upper(trim(record_a_id)) <> upper(trim(record_b_id))),
s as (select a, b from e union select b, a from e),
r(a, b) as (select a, a from s union select r.a, s.b from r join s on r.b = s.a),
g as (select a, min(b) group_root from r group by 1)
select group_root, count(*) members from g group by 1""",
    "p7_golden": f"""
with recursive {_RATED_SQL},
c as (select * from q qualify row_number() over (partition by group_id, trust, i is not null, g is not null, y is not null order by moment desc, record_id desc) = 1),
d as (select a.group_id, a.record_id over_id, b.record_id under_id from c a join c b on {_DOMINATES}),
r(group_id, record_id, depth) as (select group_id, record_id, 1 from c union select r.group_id, d.under_id, r.depth + 1 from r join d on r.group_id = d.group_id and r.record_id = d.over_id),
l as (select c.*, layer from c join (select group_id, record_id, max(depth) layer from r group by 1, 2) using (group_id, record_id)),
p as (select * from l where layer = 1 qualify row_number() over (partition by group_id order by trust, moment desc, record_id desc) = 1),
f as (select l.*, case when l.record_id = p.record_id then 0 else l.layer end turn from l join p using (group_id)),
n as (select group_id, max(layer) layers from l group by 1),
v1 as (select * from f where i is not null qualify row_number() over (partition by group_id order by turn, trust, moment desc, record_id desc) = 1),
v2 as (select * from f where g is not null qualify row_number() over (partition by group_id order by turn, trust, moment desc, record_id desc) = 1),
v3 as (select * from f where y is not null qualify row_number() over (partition by group_id order by turn, trust, moment desc, record_id desc) = 1)
select p.group_id, p.record_id, layers, v1.i imo, v2.g gross_tonnage, v3.y built_year, v1.record_id imo_from, v2.record_id gross_tonnage_from, v3.record_id built_year_from
from p join n using (group_id) left join v1 using (group_id) left join v2 using (group_id) left join v3 using (group_id)""",
    "p7_survivors": f"""
with {_RATED_SQL},
c as (select * from q qualify row_number() over (partition by group_id, complete, trust, moment order by record_id desc) = 1),
u as (select * from c b where not exists (select 1 from c a where {_DOMINATES}))
select group_id, record_id, complete as filled, count(*) over (partition by group_id) layer_size from u qualify row_number() over (partition by group_id order by trust, moment desc, complete desc, record_id desc) = 1""",
    "p7_found": f"""
with q as (select r.*, coalesce(f.trust_rank, 2147483647) trust from vessel_records r left join feeds f on r.source = f.feed_code where group_id is not null),
c as (select group_id, 'imo' field_name, record_id, trust, UpdateDate from q r where {_IMO}
 union all select group_id, 'gross_tonnage', record_id, trust, UpdateDate from q where grossTonnage > 0 and grossTonnage <= 300000
 union all select group_id, 'built_year', record_id, trust, UpdateDate from q where builtYear between 1900 and 2025)
select group_id, field_name, record_id from c qualify row_number() over (partition by group_id, field_name order by trust, UpdateDate desc nulls last, record_id desc) = 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return SQL

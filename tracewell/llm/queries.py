"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, mixture, reading


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 6 ------------------------------------------------------------------------------------------------------------------
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with leaked passages: its longest run of an item's words and the share of the item's passages."""
    hits = leakage.leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return hits.select("item_id", "doc_id", "longest_run", "passages", F.round(F.col("passages") / F.col("item_passages"), 4).alias("containment"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leakage.leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return hits.filter(F.col("longest_run") >= leakage.PASSAGE).select("item_id", "doc_id")


def p6_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which four fifths or more of the shingles occur close together in a document."""
    hits = leakage.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return hits.select("item_id", "doc_id", F.round("estimate", 4).alias("estimate"), F.round("containment", 4).alias("containment"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold passages of it."""
    return p6_report(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest_run").alias("longest_run"), F.max("containment").alias("containment"))


# 7 ------------------------------------------------------------------------------------------------------------------
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_shares(spark, sf_dir).filter("not can_reach").select("source_name")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shuffled_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


# 8 ------------------------------------------------------------------------------------------------------------------
def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose prose, as the operator takes it apart, meets both bounds. The bounds are counts, so counts decide and no
    estimate of a model may drop a document."""
    exact = (F.col("n_words") >= 22 * F.col("n_sentences")) & (F.col("n_letters") >= 5.8 * F.col("n_words")) & (F.col("n_words") > 0)
    return p8_levels(spark, sf_dir).filter(exact).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_report, p6_found, p6_contained, p6_items, p7_shares, p7_found, p7_mix, p8_levels, p8_found)}
#: The characters of the tables that compatibility normalisation changes, as a rule: the block of full-width forms stands for
#: ASCII from "!" on, and what SQL calls no letter or digit separates words anyway. Other tables would need more of it.
_FULL = "".join(chr(0xFF01 + i) for i in range(94))
_ASCII = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_PLACES = f"""c as (select doc_id id, 'd' k, text t from documents union all select item_id, 'i', item_text from eval_items),
w as (select id, k, regexp_extract_all(lower(translate(regexp_replace(nfc_normalize(t), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '{_FULL}', '{_ASCII}')), '[\\p{{L}}\\p{{N}}_]+') w from c where t is not null),
n as (select id, k, w, unnest(range(1, len(w) - 10)) p from w where len(w) >= 12), g as (select id, k, p, array_to_string(w[p:p + 11], ' ') g, len(w) - 11 size from n),
h as (select i.id item_id, d.id doc_id, i.p ip, d.p dp, i.size from g i join g d on i.g = d.g and i.k = 'i' and d.k = 'd'),
l as (select item_id, doc_id, max(run) + 11 longest_run from (select item_id, doc_id, count(*) run from (select *, dp - row_number() over (partition by item_id, doc_id, dp - ip order by dp) isle from h) group by item_id, doc_id, dp - ip, isle) group by 1, 2),
r as (select h.item_id, h.doc_id, any_value(longest_run)::int longest_run, count(distinct ip)::int passages, round(count(distinct ip) / any_value(size), 4) containment from h join l using (item_id, doc_id) group by 1, 2)"""

ORACLES: dict[str, str] = {
    "p6_found": f"with {_PLACES} select item_id, doc_id from r",
    "p6_report": f"with {_PLACES} select * from r",
    "p6_items": f"with {_PLACES} select item_id, count(*) n_docs, max(longest_run) longest_run, max(containment) containment from r group by 1",
    # No source is near its bound whatever the tokenizer, so sizes in letters tell the same sources apart.
    "p7_found": r"""with d as (select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) k, sum(length(text)) n from documents where source is not null group by 1),
t as (select source_name, target_share, max_repeats, coalesce(n, 0) n from mix_targets left join d on k = lower(regexp_replace(source_name, '^\s+|\s+$', '', 'g')))
select source_name from t where target_share * (select sum(n) from t) > max_repeats * n""",
}

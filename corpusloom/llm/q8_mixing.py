"""Queries of the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from . import mixing


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", "source", "text")


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(mixing.sizes_of(_documents(spark, folder)), load(spark, folder, "mix_targets"))


def planned(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).select("source", "target_pct", "max_repeats", "tokens", F.coalesce("needed_passes", F.lit(0)).alias("needed_passes"), F.coalesce("passes", F.lit(0)).alias("passes"), "outcome")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Passes and outcome of the sources by the blocks that the splitting tree drew."""
    return mixing.passes_drawn(mixing.draws(_plan(spark, folder)))


def drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks and shards of each pass: as the tree drew them, and as they add up."""
    rows = mixing.draws(_plan(spark, folder))
    total = F.aggregate("drawn", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select("source", "pass", "quota", total.alias("blocks"))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """How many blocks each shard gets: as even as can be."""
    own = mixing.draws(_plan(spark, folder)).select(F.posexplode("drawn").alias("shard", "n")).groupBy("shard").agg(F.sum("n").alias("blocks"))
    return own.groupBy("blocks").agg(F.count("*").alias("shards"))


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: each use of a document with its shard and place."""
    return mixing.mix(_documents(spark, folder), load(spark, folder, "mix_targets"))


def shares(spark: SparkSession, folder: str) -> DataFrame:
    """Actual and target shares of the mix."""
    return mixing.shares(mixed(spark, folder), load(spark, folder, "mix_targets"))


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix."""
    return mixing.checks(mixed(spark, folder), _plan(spark, folder))


QUERIES = {"p8_found": found, "p8_plan": planned, "p8_mix": mixed, "p8_shares": shares, "p8_draws": drawn, "p8_shards": shards, "p8_checks": checked}

_PLAN = r"""
with sizes as (
  select source, sum(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]')), 0)) as tokens
  from documents group by source),
planned as (
  select t.source, t.target_pct, t.max_repeats, coalesce(s.tokens, 0)::bigint as tokens,
    case when s.tokens > 0 then ceil(t.target_pct * (select sum(tokens) from sizes) / (100.0 * s.tokens))::bigint end as needed_passes
  from mix_targets t left join sizes s on t.source = s.source)
select source, target_pct, max_repeats, tokens, coalesce(needed_passes, 0) as needed_passes, case when tokens > 0 then least(needed_passes, max_repeats) else 0 end as passes,
  case when tokens = 0 then 'empty' when needed_passes <= max_repeats then 'reached' else 'capped' end as outcome
from planned"""
_SUM = r"sum(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]')), 0))"
_TARGETS = f"""
select *, least(target_tokens, passes * tokens) as planned_tokens
from (select p.*, (target_pct * t.n + 99) // 100 as target_tokens from ({_PLAN}) p, (select {_SUM}::bigint as n from documents) t)"""
_DRAWS = f"""
select source, pass, quota, greatest(1, (4096 * quota + tokens - 1) // tokens) as blocks from (
  select source, pass, tokens, least(tokens, planned_tokens - (pass - 1) * tokens) as quota from (
    select *, unnest(range(1, passes + 1)) as pass from ({_TARGETS}) where passes > 0)) where quota > 0"""
SQL = {
    "p8_plan": _PLAN,
    "p8_found": f"select source, passes, outcome from ({_PLAN}) where needed_passes > 1",
    "p8_draws": _DRAWS,
    "p8_shards": f"select blocks, count(*) as shards from (select (n * (k + 1)) // 16 - (n * k) // 16 as blocks from (select sum(blocks)::bigint as n from ({_DRAWS})), (select unnest(range(0, 16)) as k)) group by blocks",
    "p8_checks": f"""
select source, planned_tokens // tokens as full_passes, (planned_tokens // tokens) * n as full_uses, 0::bigint as repeated, true as enough, true as tight
from ({_TARGETS}) join (select source, count(*) as n from documents where text is not null and doc_id is not null group by source) using (source) where planned_tokens > 0""",
}

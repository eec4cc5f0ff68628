"""Mixing sources to target shares of tokens.

A plan gives each source its passes; a multivariate-hypergeometric splitting tree then parts the exact numbers of each
source's blocks among output shards, and each shard draws its own disjoint range of the source's permuted blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration
from ..functions.words import JAVA_TOKEN
from ..session import checkpoint, tune

#: Passes whose blocks are split in one task; a tree over such groups comes before.
GROUP = 500
#: Passes that are sent to every task at most (their shards of blocks take 16 KB each); more are joined.
MAX_BROADCAST = 1_000


def token_count(text: Column) -> Column:
    """Maximal runs of letters or digits, and any other single characters that aren't white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_TOKEN)), F.lit(0)).cast("bigint")


def targets_of(targets: DataFrame) -> DataFrame:
    """One row per source: the largest share and cap it is given; null sources, and null or non-positive shares, are left out."""
    return targets.where("source is not null and target_pct > 0").groupBy("source").agg(F.max("target_pct").alias("target_pct"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources with their passes, from (source, tokens) of all documents, null source included, and (source, target_pct, max_repeats).

    source, target_pct, max_repeats, tokens, all_tokens, target_tokens (its share of all), needed_passes (least n with n x tokens >= that share; null
    without tokens), passes (at most max_repeats), outcome (reached, capped, or empty where the source has no tokens),
    planned_tokens (what the mix takes), planned_pct (of all that is taken). Both tables have a row per source and are added up in parts.
    """
    sizes = checkpoint(sizes)  # the documents are read once
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    out = targets_of(targets).join(sizes.where("source is not null"), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    out = out.withColumn("all_tokens", F.lit(total).cast("bigint")).withColumn("target_tokens", F.expr("(target_pct * all_tokens + 99) div 100"))
    needed = F.expr("case when tokens > 0 then (target_tokens + tokens - 1) div tokens end")
    out = out.withColumn("needed_passes", needed).withColumn("passes", F.when(F.col("tokens") > 0, F.least("needed_passes", "max_repeats")))
    out = out.withColumn("outcome", F.expr("case when tokens = 0 then 'empty' when needed_passes <= max_repeats then 'reached' else 'capped' end"))
    out = checkpoint(out.withColumn("planned_tokens", F.expr("least(target_tokens, coalesce(passes, 0) * tokens)")))
    taken = out.agg(F.sum("planned_tokens")).first()[0]
    return out.withColumn("planned_pct", 100 * F.col("planned_tokens") / F.lit(taken))


def sizes_of(documents: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """source (null included), documents, tokens: added up on the map side, so a source that holds most rows costs no skew."""
    return documents.select(F.col(source).alias("source"), token_count(F.col(text)).alias("_n")).groupBy("source").agg(F.count("*").alias("documents"), F.sum("_n").alias("tokens"))


@dataclass(frozen=True)
class MixConfig:
    shards: int = 16
    #: Blocks of a source; the permutation draws whole blocks, of a pass in part the last one by documents. At 100 TB a block is then about 1e-4 of a source.
    blocks: int = 4096
    seed: int = 7

    def __post_init__(self) -> None:
        if self.shards < 1 or self.blocks < 1:
            raise InvalidConfiguration("shards and blocks must be greater than zero")


def split_tree(quotas: list[int], room: list[int], rng: np.random.Generator) -> np.ndarray:
    """(shards x sources) counts that add up to ``quotas`` and to the ``room`` of each shard: halve the shards again and again.

    At each node the left half gets what it has room for of the node's blocks, drawn without replacement over all sources at once.
    """
    before = np.concatenate(([0], np.cumsum(room)))
    out = np.zeros((len(room), len(quotas)), dtype=np.int64)

    def part(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        take = int(before[middle] - before[low])
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if take else np.zeros_like(counts)
        part(low, middle, left)
        part(middle, high, counts - left)

    part(0, len(room), np.asarray(quotas, dtype=np.int64))
    return out


def even_room(blocks: int, shards: int) -> list[int]:
    """``blocks`` over shards as evenly as can be."""
    return [blocks * (k + 1) // shards - blocks * k // shards for k in range(shards)]


_DRAWN = "source string, `pass` bigint, tokens bigint, target_tokens bigint, part boolean, quota bigint, drawn array<bigint>, shard_of array<int>"


def draws(planned: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The leaves of the splitting tree: a row for each pass of each source of a plan.

    source, pass (from 1), tokens (of the source), target_tokens, part (whether only part of the source is wanted), quota (tokens wanted), drawn
    (blocks for each shard: all blocks of the source, or as many as its part takes), shard_of (the shard of each block). Shards
    get equal numbers of blocks. The tree first parts groups of ``GROUP`` passes, then each group the passes within it, which draws as one tree over all
    would; its uppermost nodes may hold a billion blocks.
    """
    wanted = F.expr("least(tokens, planned_tokens - (pass - 1) * tokens)")
    rows = planned.where("passes > 0").select("source", "tokens", "target_tokens", "planned_tokens", F.explode(F.expr("sequence(1L, passes)")).alias("pass")).withColumn("quota", wanted).where("quota > 0")
    rows = rows.withColumn("blocks", F.expr(f"greatest(1L, ({config.blocks} * quota + tokens - 1) div tokens)")).withColumn("part", F.col("quota") < F.col("tokens"))
    groups = max(1, -(-rows.count() // GROUP))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("source", "pass"), F.lit(groups)))
    sums = {r["_group"]: r["n"] for r in rows.groupBy("_group").agg(F.sum("blocks").alias("n")).collect()}  # a row for each GROUP passes
    if sum(sums.values()) >= 10**9:
        raise InvalidConfiguration("10^9 blocks or more in all; choose fewer blocks a source")
    names = sorted(sums)
    tree = split_tree([sums[g] for g in names], even_room(sum(sums.values()), config.shards), np.random.default_rng(config.seed)) if names else np.zeros((config.shards, 0), dtype=np.int64)
    rooms = planned.sparkSession.createDataFrame([(g, tree[:, k].tolist()) for k, g in enumerate(names)], "_group bigint, room array<bigint>")

    def split(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["source", "pass"], ignore_index=True)
        rng = np.random.default_rng((config.seed, int(own["_group"][0])))
        counts = split_tree(own["blocks"].tolist(), list(own["room"][0]), rng)
        shard_of = []
        for k, n in enumerate(own["blocks"]):
            of = np.arange(config.blocks, dtype=np.int32) % config.shards  # blocks past the quota, should its last one fall short
            of[rng.permutation(n)] = np.repeat(np.arange(config.shards, dtype=np.int32), counts[:, k])
            shard_of.append(of)
        out = own[["source", "pass", "tokens", "target_tokens", "part", "quota"]].copy()
        out["drawn"], out["shard_of"] = list(counts.T), shard_of
        return out

    tune(planned.sparkSession)
    return rows.join(rooms, "_group").groupBy("_group").applyInPandas(split, _DRAWN)


def passes_drawn(drawn: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """source, passes, outcome of sources that one pass doesn't suffice, by the blocks that the tree drew of them.

    A source is reached where its blocks, of as many tokens each as its share of them, come to its target, else capped.
    """
    blocks = F.aggregate("drawn", F.lit(0).cast("bigint"), lambda a, n: a + n)
    own = drawn.withColumn("_n", blocks).groupBy("source").agg(F.max("pass").alias("passes"), F.sum("_n").alias("_n"), F.max("tokens").alias("_tokens"), F.max("target_tokens").alias("_target"))
    enough = F.col("_n") * F.col("_tokens") >= config.blocks * F.col("_target")
    return own.where("_tokens < _target").select("source", "passes", F.when(enough, "reached").otherwise("capped").alias("outcome"))


def mix(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, pass (from 1), tokens, shard, place (in the shard, a random order): the mixed documents.

    Each planned source is used whole for its full passes and in part for the last, so its tokens come to its planned ones up to
    the size of its last document. Rows with a null key, source or text, and sources without a target, are left out; rows with the
    same key are distinct documents only if the caller leaves them so. Empty texts have no tokens and come with every full pass.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"), F.col(text).isNotNull().alias("_has"))
    drawn = checkpoint(draws(plan(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets), config).drop("tokens", "target_tokens", "drawn"))
    sent = F.broadcast if drawn.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else lambda df: df
    documents_ = rows.where("_has and doc_id is not null and source is not null").drop("_has")
    block = F.pmod(F.xxhash64("doc_id", "pass", F.lit(config.seed)), F.lit(config.blocks)).cast("int")
    # the shards of blocks are looked up last, so no row carries them
    placed = documents_.join(sent(drawn.drop("shard_of")), "source").withColumn("block", block)
    last = placed.where("part")
    # a pass in part takes blocks in order until its tokens are reached
    totals = last.groupBy("source", "pass", "quota", "block").agg(F.sum("tokens").alias("n"))
    before = totals.withColumn("before", F.expr("sum(n) over (partition by source, pass order by block) - n")).where("before < quota").select("source", "pass", "block", "before", (F.col("before") + F.col("n") > F.col("quota")).alias("cut"))
    kept = last.join(before, ["source", "pass", "block"])
    # only the one block where that happens is ordered by document: a pass's quota falls within at most one
    run = F.expr("sum(tokens) over (partition by source, pass order by xxhash64(doc_id), doc_id) - tokens")
    cut = kept.where("cut").withColumn("_run", F.col("before") + run).where("_run < quota").drop("_run")
    both = placed.where("not part").unionByName(kept.where("not cut").unionByName(cut).drop("before", "cut")).drop("part", "quota")
    both = both.join(sent(drawn.select("source", "pass", "shard_of")), ["source", "pass"])
    place = F.xxhash64("doc_id", "pass", F.lit(config.seed + 1)).alias("place")
    return both.select("doc_id", "source", "pass", "tokens", F.col("shard_of")[F.col("block")].alias("shard"), place)


def checks(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """What must hold of a mix, for each source that it has: source, full_passes (all documents in each), full_uses (rows of these), repeated (documents
    drawn twice in a pass), enough and tight (the pass in part has the tokens it is to have, and would not without its largest document).
    """
    uses = mixed.groupBy("source", "pass", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    own = uses.groupBy("source", "pass").agg(F.sum("n").alias("uses"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"), F.sum("tokens").alias("taken"), F.max("largest").alias("largest"))
    plan_ = planned.select("source", F.col("tokens").alias("_all"), "planned_tokens", F.expr("case when tokens > 0 then planned_tokens div tokens end").alias("full_passes"))
    own = own.join(plan_, "source").withColumn("_left", F.expr("planned_tokens - (pass - 1) * _all")).withColumn("_full", F.expr("pass <= full_passes"))
    return own.groupBy("source", "full_passes").agg(
        F.sum(F.when(F.col("_full"), F.col("uses")).otherwise(0)).alias("full_uses"),
        F.sum("repeated").alias("repeated"),
        F.min(F.expr("taken >= least(_left, _all)")).alias("enough"),
        F.min(F.expr("_full or taken - largest < _left")).alias("tight"),
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, documents, tokens, actual_pct, target_pct, distinct_documents of a mix: what each source came to, one row per source of the targets."""
    own = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("pass").alias("passes"))
    own = checkpoint(own)
    taken = own.agg(F.sum("tokens")).first()[0]
    out = targets_of(targets).join(own, "source", "left").withColumn("_all", F.lit(taken))
    return out.select("source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "passes", F.expr("100 * coalesce(tokens, 0) / _all").alias("actual_pct"), "target_pct")

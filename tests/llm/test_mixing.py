import re

import numpy as np

from corpusloom.llm import mixing


def tables(spark):
    documents = [(k, f"word{k}, and " * (k % 7 + 1), ("big" if k % 3 else "small") if k % 11 else None) for k in range(3000)]
    documents += [(5000 + k, "tiny text", "tiny") for k in range(5)] + [(6000, None, "big"), (None, "x", "big"), (6001, "", "small")]
    df = spark.createDataFrame([(*d, 1) for d in documents], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 40, 2), ("small", 50, 2), ("tiny", 8, 3), ("none", 2, 4), (None, 3, 1), ("big", 40, 2)], "source string, target_pct bigint, max_repeats bigint")
    return documents, df, targets


def test_plan_and_mix(spark):
    documents, df, targets = tables(spark)
    count = lambda t: len(re.findall(r"[^\W_]+|[^\w\s]|_", t or ""))
    sizes = {}
    for _, t, s in documents:
        sizes[s] = sizes.get(s, 0) + count(t)
    total = sum(sizes.values())
    plan = {r["source"]: r for r in mixing.plan(mixing.sizes_of(df), targets).collect()}
    assert set(plan) == {"big", "small", "tiny", "none"}
    for s, pct, cap in (("big", 40, 2), ("small", 50, 2), ("tiny", 8, 3)):
        n = next(n for n in range(1, 10**6) if n * sizes[s] * 100 >= pct * total)
        assert (plan[s]["needed_passes"], plan[s]["passes"], plan[s]["outcome"]) == (n, min(n, cap), "reached" if n <= cap else "capped")
    assert plan["none"]["outcome"] == "empty" and plan["none"]["passes"] is None
    config = mixing.MixConfig(shards=5, blocks=64)
    rows = mixing.mix(df, targets, config).collect()
    assert rows == [] or sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(3), targets, config).collect()))
    uses = {}
    for r in rows:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["pass"])
    assert all(len(set(p)) == len(p) <= plan[s]["passes"] for (s, _), p in uses.items())
    for s in ("big", "small", "tiny"):
        taken = sum(r["tokens"] for r in rows if r["source"] == s)
        assert plan[s]["planned_tokens"] <= taken + 2 and taken < plan[s]["planned_tokens"] + 40
        per_shard = [sum(r["tokens"] for r in rows if r["source"] == s and r["shard"] == k) for k in range(5)]
        assert s == "tiny" or max(per_shard) < 3 * max(1, min(per_shard))
    shares = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets, config), targets).collect()}
    assert abs(sum(r["actual_pct"] for r in shares.values()) - 100) < 1e-6 and shares["none"]["tokens"] == 0
    assert mixing.mix(df.limit(0), targets, config).count() == 0 and mixing.mix(df, targets.limit(0), config).count() == 0


def test_tree_splits_exactly():
    rng = np.random.default_rng(0)
    for quotas, shards in (([10, 0, 7], 4), ([4096] * 9, 16), ([1], 3), ([5, 5], 1)):
        room = mixing.even_room(sum(quotas), shards)
        tree = mixing.split_tree(quotas, room, rng)
        assert tree.sum(axis=0).tolist() == quotas and (tree >= 0).all()
        assert tree.sum(axis=1).tolist() == room and max(room) - min(room) <= 1


def test_passes_come_from_the_tree(spark, monkeypatch):
    _, df, targets = tables(spark)
    planned = mixing.plan(mixing.sizes_of(df), targets)
    want = {(r["source"], r["passes"], r["outcome"]) for r in planned.collect() if r["needed_passes"] and r["needed_passes"] > 1}
    for group, broadcast in ((500, 1000), (1, 0)):  # one group, and as many as there are passes; sent, and joined
        monkeypatch.setattr(mixing, "GROUP", group)
        monkeypatch.setattr(mixing, "MAX_BROADCAST", broadcast)
        config = mixing.MixConfig(shards=5, blocks=64)
        drawn = mixing.draws(planned, config).collect()
        per_shard = [sum(r["drawn"][k] for r in drawn) for k in range(5)]
        assert max(per_shard) - min(per_shard) <= 1
        assert all(sorted(r["shard_of"]).count(k) >= r["drawn"][k] for r in drawn for k in range(5))
        assert {tuple(r) for r in mixing.passes_drawn(mixing.draws(planned, config), config).collect()} == want
        rows = mixing.checks(mixing.mix(df, targets, config), planned).collect()
        assert {r["source"] for r in rows} == {"big", "small", "tiny"} and all(r["repeated"] == 0 and r["enough"] and r["tight"] for r in rows)


def test_tokens(spark):
    rows = spark.createDataFrame([("a b_c ²x", 5), ("", 0), (None, 0), ("é—1.5\u00a0x", 6), ("\x1c \x85\u3000", 0)], "t string, n int")
    assert [r["n"] == r["c"] for r in rows.withColumn("c", mixing.token_count(rows["t"])).collect()] == [True] * 5

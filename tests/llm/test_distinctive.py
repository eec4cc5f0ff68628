import math
from collections import Counter

from corpusloom.functions.words import terms
from corpusloom.llm import distinctive


def test_scores_equal_brute_force(spark):
    texts = {1: "Gizofo gizofo river, the RIVER", 2: "river bank bank", 3: "", 4: "no long", 5: "élan élan ²abcd x1river", 6: "word " * 50_000}
    rows = [(k, t.encode(), "txt", "x") for k, t in texts.items()] + [(7, None, "txt", "x"), (None, b"abcd", "txt", "x"), (8, b"<a>cut", "xml", "x"), (9, b"<a>\xc3\xa9lan<b>river</b>s</a>", "xml", "x"), (10, b"{", "json", "x"), (11, b"\xffword", "txt", "x")]
    texts |= {9: "élan river s", 11: "\ufffdword"}
    df = spark.createDataFrame(rows, "index bigint, bytes binary, form string, term string")
    got = {(r["index"], r["term"]): r for r in distinctive.scores(distinctive.record_terms(df)).collect()}
    counts = {k: Counter(t for t in terms(x) if len(t) >= 4) for k, x in texts.items()}
    df_, cf, n = Counter(t for c in counts.values() for t in c), sum(counts.values(), Counter()), len(counts)
    assert set(got) == {(k, t) for k, c in counts.items() for t in c}
    for (k, t), r in got.items():
        want = counts[k][t] * (-math.log2(df_[t] / n) + math.log2(1 - math.exp(-cf[t] / n)))
        assert (r["tf"], r["df"], r["cf"]) == (counts[k][t], df_[t], cf[t]) and math.isclose(r["score"], want, abs_tol=1e-9)
    assert distinctive.scores(distinctive.record_terms(df.limit(0))).count() == 0
    plain = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(99, None)], "id bigint, t string")
    again = {(r["index"], r["term"]): (r["tf"], r["df"]) for r in distinctive.scores(distinctive.text_terms(plain, "id", "t")).collect()}
    assert again == {k: (r["tf"], r["df"]) for k, r in got.items()}
    rare = {tuple(r) for r in distinctive.concentrated(distinctive.scores(distinctive.record_terms(df)), 2, 2).select("index", "term").collect()}
    assert rare == {(k, t) for k, t in got if counts[k][t] >= 2 and df_[t] <= 2}


def test_concentrated_terms_at_any_size(spark):
    for n in (1, 2, 3, 10, 5000):
        rows = [(k, None, 0) for k in range(n)]
        for d in range(1, min(n, 5) + 1):
            rows += [(k, f"edge{d}", 4 if k == 0 else 1) for k in range(d)] + [(k, f"much{d}", 4000) for k in range(d)] + [(k, f"less{d}", 3) for k in range(d)]
        rows += [(k, "every", 9) for k in range(n)]
        counts = spark.createDataFrame(rows, "index bigint, term string, tf bigint")
        got = {tuple(r) for r in distinctive.concentrated(distinctive.scores(counts), 4, 3).select("index", "term").collect()}
        df_ = Counter(t for _, t, _ in rows)
        assert got == {(k, t) for k, t, tf in rows if t and tf >= 4 and df_[t] <= 3}, n

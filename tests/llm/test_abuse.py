import random

import numpy as np

from corpusloom.llm import abuse


def corpus(seed, n=400):
    rng = random.Random(seed)
    jobs, things = ["miner", "judge", "baker", "clerk"], ["mill", "bridge", "archive", "well", "tower"]
    plain = [lambda: f"The {rng.choice(jobs)} closed the {rng.choice(things)} in {rng.randrange(1500, 1999)}.", lambda: f"A {rng.choice(things)} stands where the {rng.choice(things)} once was.", lambda: "In the comedy a judge calls him an idiot and they laugh."]
    bad = {"abusive": [lambda: f"Shut up, you pathetic idiot of the {rng.choice(things)}.", lambda: "What a complete idiot you are, crawl back under your rock."], "hateful": [lambda: "They are vermin and should be driven out of here."]}
    out = []
    for _ in range(n):
        own = [rng.choice(plain)() for _ in range(rng.randrange(3, 9))]
        kinds = {k for k in bad if rng.random() < 0.15}
        for k in kinds:
            s = rng.choice(bad[k])()
            s = rng.choice([s, s.upper(), s.replace("idiot", "1d10t").replace("vermin", "v e r m i n"), s.replace("idiot", "idiiiot")])
            own.insert(rng.randrange(len(own) + 1), s)
        out.append((" ".join(own), kinds))
    return out


def test_readings():
    flat = [w for s in abuse.sentences("Such an i m b e c i l e here. A 1mb3c1l3 and a hоusе of 1923 here.") for w in s]
    assert flat.count("imbecile") == 2 and "house" in flat and "<num>" in flat
    assert abuse.sentences(None) == abuse.sentences("") == []
    assert max(map(len, abuse.sentences("word " * 1000))) == 40


def test_stretches_overlap():
    for n in (40, 41, 59, 60, 61, 97, 100, 120, 200):
        words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
        cut = abuse.sentences(" ".join(words))
        assert max(map(len, cut)) == 40 and all(any(words[k : k + 20] == s[j : j + 20] for s in cut for j in range(21)) for k in range(n - 19)), n
        assert {w for s in cut for w in s} == set(words)


def test_held_out_accuracy():
    scorer = abuse.fit(corpus(1))
    test = corpus(2)
    bag = abuse._Bag([abuse.sentences(t) for t, _ in test], scorer.vocabulary)
    scores = scorer.documents(bag, len(test))
    for k, c in enumerate(scorer.categories):
        said, true = scores[:, k] >= scorer.thresholds[c], np.array([c in x for _, x in test])
        assert (said & true).sum() >= 0.9 * true.sum() and (said & ~true).sum() <= 0.1 * true.sum()


def test_probabilities_add_up():
    scorer = abuse.fit(corpus(3, 60))
    size = scorer.size
    for model in scorer.models.values():
        for context in (0, 5 * size + 9, size * size - 1):
            total = model.probability(context * size + np.arange(size), size, scorer.shared).sum()
            assert abs(total - 1) < 1e-6


def test_operator_on_awkward_rows(spark):
    data = [(k, t, x) for k, (t, x) in enumerate(corpus(4, 200))]
    documents = spark.createDataFrame([(k, t, "s", 0.5) for k, t, _ in data] + [(900, None, "s", 0.5), (901, "", None, 0.5), (None, "x", "s", 0.5), (902, "word " * 50_000, "s", 0.5)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(k, c.upper() + " ") for k, _, x in data for c in (x or {"clean"})] * 2 + [(3, None), (4, "odd"), (None, "clean")], "doc_id bigint, label string")
    sample = abuse.labelled_sample(documents, labels)
    assert len(sample) == 200 and sorted(map(str, (x for _, x in sample))) == sorted(map(str, (x for _, _, x in data)))
    few = abuse.labelled_sample(documents, labels, abuse.AbuseConfig(max_bytes=16_000))  # whole texts, up to 4,000 bytes a label
    assert 0 < len(few) < 200 and {t for t, _ in few} <= {t for t, _ in sample}
    for label in ("clean", "abusive", "hateful"):
        assert sum(len(t.encode()) for t, x in few if (label in x or label == "clean" and not x)) <= 4_000
    scored = abuse.score(documents, abuse.fit(sample))
    rows = scored.collect()
    assert len(rows) == 203 * 2 and {r["score"] for r in rows if r["doc_id"] in (900, 901)} == {None} and not any(r["flagged"] for r in rows if r["doc_id"] in (900, 901))
    rates = {(r["source"], r["category"]): r for r in abuse.rates(scored, documents.select("doc_id", "source")).collect()}
    assert rates[None, "abusive"]["documents"] == 1 and rates["s", "abusive"]["flagged"] == sum(r["flagged"] for r in rows if r["category"] == "abusive")
    assert abuse.score(documents, None).count() == 0 and abuse.score(documents.limit(0), abuse.fit(sample)).count() == 0
    assert abuse.fit([]) is None and abuse.fit([("x y z", {"abusive"})]) is None


def test_thresholds_are_fitted():
    scores, truth = np.array([5, 4, 4, 3, 1, 0, -1.0]), np.array([1, 1, 1, 1, 0, 0, 0], dtype=bool)
    # any score from 3 down to 1 is the best; two thirds up that range, drawn to the prior by four cases against fifty
    assert abs(abuse._threshold(scores, truth) - (4 * (2 * 3 + 1) / 3 + 50 * 1.5) / 54) < 1e-9
    many = abuse._threshold(np.repeat(scores + 7, 1000), np.repeat(truth, 1000))
    assert abs(many - (7 + 7 / 3)) < 0.1

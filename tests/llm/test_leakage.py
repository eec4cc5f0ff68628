import random
import unicodedata

from corpusloom.llm.leakage import LeakConfig, common_subsequence, leaks, normal_words


def brute(documents, items, size):
    grams = {}
    for i, t, _ in items:
        w = normal_words(t)
        for k in range(len(w) - size + 1):
            grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = set()
    for d, t in documents:
        w = normal_words(t)
        for k in range(len(w) - size + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + size]), ())}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    common = [f"c{k}" for k in range(30)]
    make = lambda n: [rng.choice(words if rng.random() < 0.5 else common) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([5, 14, 40, 90]))), rng.choice([None, "w1 w2", ""])) for k in range(40)]
    documents = []
    for d in range(400):
        w = make(rng.choice([0, 8, 60, 200]))
        if rng.random() < 0.5:
            source = items[rng.randrange(40)][1].split()
            a = rng.randrange(max(1, len(source) - 12))
            w[len(w) // 2 : len(w) // 2] = source[a : a + rng.choice([9, 11, 12, 13, 30])]
        text = rng.choice([" ", ", ", " -- "]).join(w)
        documents.append((d, text.upper() if rng.random() < 0.2 else text))
    documents += [(1000, None), (None, items[0][1]), (1001, ""), (1002, items[2][1].translate({c: c + 0xFEE0 for c in range(0x61, 0x7B)})), (1003, " ".join(make(30_000)) + " " + items[3][1])]
    assert unicodedata.normalize("NFKC", documents[-2][1]).split() == items[2][1].split()
    df = spark.createDataFrame([(*d, "x") for d in documents], "doc_id bigint, text string, codes string")
    it = spark.createDataFrame(items + [(5, items[5][1], None), (None, "a", None)], "item_id bigint, text string, answer string")
    found = leaks(df, it, LeakConfig(rank=48)).collect()
    exact = {(r["doc_id"], r["item_id"]) for r in found if r["kind"] == "exact"}
    want = brute([x for x in documents if x[0] is not None and x[1]], items, 12)
    assert want and exact == want
    assert all(r["run"] >= 12 for r in found if r["kind"] == "exact") and all(r["answer"] is None for r in found if items[r["item_id"]][2] in (None, ""))
    blocks = leaks(df, it, LeakConfig(rank=48, block_words=120)).where("kind = 'exact'").collect()  # the items in many blocks
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks) == sorted(want)
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0


def test_paraphrases(spark):
    item = "the keeper of the northern tower counted nine hundred travellers beside the common festival before the evening bell rang over butrot".split()
    near = [w for k, w in enumerate(item) if k % 6]
    df = spark.createDataFrame([(1, "quite other words stand in this one about nothing at all"), (2, "indeed " + " ".join(near) + " and dratheas said so")], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join(item), "Dratheas")], "item_id bigint, text string, answer string")
    rows = leaks(df, it, LeakConfig(paraphrase_cosine=0.5)).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"], r["answer"]) for r in rows] == [(2, 7, "paraphrase", True)]


def test_runs_among_other_items_are_found(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{k}x{j}" for j in range(60)), None) for k in range(60)] + [(k, " ".join(rng.choice(common) for _ in range(12)), None) for k in range(60, 80)]
    texts = [t.split() for _, t, _ in items]
    documents = [(d, " ".join(rng.choice(common) for _ in range(60))) for d in range(300)]
    for d in range(300, 600):  # a run of common words between rare words of two other items
        left, right = ([w for w in texts[rng.randrange(60)] if w[0] == "r"][:11] for _ in range(2))
        documents.append((d, " ".join([*left, *texts[rng.randrange(60, 80)], *right])))
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    rows = leaks(df, spark.createDataFrame(items, "item_id bigint, text string, answer string")).collect()
    exact = [(r["doc_id"], r["item_id"]) for r in rows if r["kind"] == "exact"]
    assert len(exact) == len(set(exact)) and set(exact) == brute(documents, items, 12)
    assert min(r["cosine"] for r in rows if r["kind"] == "exact") < 0.5


def test_second_nearest_passage_may_be_the_paraphrase(spark):
    item = [f"w{k}" for k in range(24)]
    shuffled, near = item[::-1], [w for k, w in enumerate(item) if k % 8 != 7]
    text = " ".join([*shuffled, *near, "z", "z", "z"])  # the same words in another order are nearer
    df = spark.createDataFrame([(1, text), (2, "quite other words")], "doc_id bigint, text string")
    rows = leaks(df, spark.createDataFrame([(7, " ".join(item), None)], "item_id bigint, text string, answer string")).collect()
    assert [(r["doc_id"], r["kind"]) for r in rows] == [(1, "paraphrase")]


def test_recall_of_paraphrases(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([24, 60]))), None) for k in range(100)]
    documents, planted = [], set()
    for d in range(800):
        w = [rng.choice(words) for _ in range(rng.choice([5, 80, 200]))]
        if d % 4 == 0:
            source = items[rng.randrange(100)]
            own = source[1].split()[:24]
            for k in range(3, 24, 7):  # every seventh word is another, so no run is left
                own[k] = rng.choice(words)
            planted.add((d, source[0]))
            at = rng.randrange(len(w))
            w[at:at] = own
        documents.append((d, " ".join(w)))
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    rows = leaks(df, spark.createDataFrame(items, "item_id bigint, text string, answer string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] == "paraphrase"}
    assert found <= planted and len(found & planted) >= 0.9 * len(planted)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]

import random

import numpy as np

from normgraph.llm import leakage as lk
from normgraph.llm.words import WORD
from tests.conftest import rows


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, text in docs:
        v = WORD.findall((text or "").lower())
        for k in range(len(v) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(v[k : k + n]), ())}
    return sorted(out, key=str)


def world(seed, n_docs=400, n_items=30):
    rnd = random.Random(seed)
    common = [f"c{k}" for k in range(60)]
    frames = [rnd.choices(common, k=6) for _ in range(12)]

    def text(own, k):
        out = []
        for _ in range(k):
            out += rnd.choice(frames)[:4] + [f"{own}{rnd.randrange(5000)}"] + rnd.choice(frames)[4:]
        return out

    items = [(i, text("i", rnd.randrange(4, 12))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        t = text("d", rnd.randrange(5, 40))
        for _ in range(rnd.choice((0, 0, 1, 2))):
            w = rnd.choice(items)[1]
            k = rnd.choice((8, 11, 12, 12, 13, 18, 30))
            at = rnd.randrange(max(1, len(w) - k))
            t[(p := rnd.randrange(len(t))) : p] = w[at : at + k]
        docs.append((d, rnd.choice((" ", ", ", "\n")).join(t).capitalize()))
    return docs, [(i, " ".join(t)) for i, t in items]


def test_every_run_of_twelve_is_found(spark):
    for seed in (1, 2):
        docs, items = world(seed)
        df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item int").repartition(5)
        got = rows(lk.leaked_items(df, spark.createDataFrame(items, "item_id long, text string")))
        want = brute(docs, items)
        assert got == want and len(want) > 30


def test_light_run_between_heavy_words(spark):
    # the run is of words that all documents have; its neighbours are rare words of other items
    rnd = random.Random(5)
    light = [f"c{k}" for k in range(12)]
    heavy = [[f"h{i}x{k}" for k in range(30)] for i in range(40)]
    items = [(0, " ".join(light))] + [(1 + i, " ".join(w)) for i, w in enumerate(heavy)]
    docs = [(d, " ".join(rnd.sample(light, 12))) for d in range(400)]
    for d in range(20):
        a, b = rnd.sample(heavy, 12), rnd.sample(heavy, 12)
        docs.append((400 + d, " ".join([rnd.choice(w) for w in a] + light + [rnd.choice(w) for w in b])))
    want = brute(docs, items)
    assert len(want) >= 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(lk.leaked_items(df, spark.createDataFrame(items, "item_id long, text string"))) == want


def test_edge_cases(spark):
    run = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, run), (2, None), (3, ""), (4, "too short"), (5, run.upper() + " more")], "item_id long, text string")
    docs = [(1, f"x {run}, y"), (2, None), (3, ""), (4, "one two three"), (None, run), (6, run), (6, run), (7, run.replace("six", "six x")), (8, "z " * 30_000 + run + " z" * 30_000), (9, run.replace(" ", ". "))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted({(d, i) for d in (1, None, 6, 8, 9) for i in (1, 5)}, key=str)
    assert rows(lk.leaked_items(df, items)) == want
    assert lk.leaked_items(df.limit(0), items).count() == 0 and lk.leaked_items(df, items.limit(0)).count() == 0
    assert rows(lk.leaked_items(df, items.filter("item_id = 4"))) == []


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(40):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(0, 30))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert lk.longest_common_subsequence(np.array(a), np.array(b)) == t[-1, -1]


def test_svd(spark):
    rnd = np.random.default_rng(2)
    data = [rnd.choice(40, 8, replace=False).tolist() for _ in range(200)]
    weights = rnd.uniform(1, 3, 40)
    a = np.zeros((200, 40))
    for k, ids in enumerate(data):
        a[k, ids] = weights[ids]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = lk.randomised_svd(spark.createDataFrame([(d,) for d in data], "ids array<int>").repartition(3), weights, 5, rounds=6)
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    exact = np.linalg.svd(a)[1][:5]
    assert np.allclose(np.linalg.norm(a @ v, axis=0), exact, rtol=0.02)


def test_recall_on_zipf_words(spark):
    # words of natural frequencies, runs of twelve in other text, from a few items to some thousands (several shards)
    for n_items in (30, 300, 3000):
        rnd = np.random.default_rng(n_items)
        draw = lambda k: [f"z{x}" for x in np.minimum(rnd.zipf(1.3, k), 50_000)]  # noqa: B023, E731
        items = [(i, " ".join(draw(80))) for i in range(n_items)]
        docs = []
        for d in range(600):
            w = items[rnd.integers(n_items)][1].split()
            at = rnd.integers(len(w) - 12)
            docs.append((d, " ".join(draw(60) + w[at : at + 12] + draw(60))))
        got = rows(lk.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
        want = brute(docs, items)
        assert got == want and len(want) >= 600


def test_paraphrases_and_answers(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    items = [(i, " ".join(rnd.sample(words, 40)), f"answer {i}") for i in range(50)]
    docs, want = [], set()
    for d in range(200):
        t = rnd.choices(words, k=80)
        if d % 2:
            i, text, _ = rnd.choice(items)
            w = text.split()
            for k in range(5, 40, 6):  # one word in six is another
                w[k] = f"x{k}"
            t[30:30] = w
            want.add((d, i))
            if d % 4 == 1:
                t += ["Answer", str(i)]
        docs.append((d, " ".join(t)))
    report = lk.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string"), answer="answer").collect()
    found = {(r.doc_id, r.item_id) for r in report if r.kind == "paraphrase"}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 2
    assert all(r.share >= 0.6 for r in report) and all(r.answered == (r.doc_id % 4 == 1) for r in report if (r.doc_id, r.item_id) in want)

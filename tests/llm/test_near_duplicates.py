import random

import numpy as np

from normgraph.llm import near_duplicates as nd
from normgraph.llm.hashing import most_unequal
from normgraph.llm.words import WORD, WordHasher, counted, runs
from tests.conftest import rows


def brute(records, least=0.6, least_runs=15):
    sets = {}
    for i, *texts in records:
        s = set()
        for t in texts:
            w = WORD.findall((t or "").lower())
            s |= {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        sets[i] = s
    ids = sorted(i for i in sets if i is not None and len(sets[i]) >= least_runs)
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)


def records(seed=3, n=60):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    out, i = [], 0
    for _ in range(n):
        base = rnd.choices(words, k=rnd.randrange(40, 90))
        for _ in range(rnd.randrange(1, 5)):
            t = list(base)
            for _ in range(rnd.randrange(0, 6)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            i += 1
            out.append((i, " ".join(base[:30]) if rnd.random() < 0.5 else None, " ".join(t)))
    return out


SCHEMA = "change_id long, base_text string, target_text string"


def found(spark, data, extra=""):
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA + ", sig string")
    members, links = nd.near_duplicates(df, "change_id", ["base_text", "target_text"])
    m = {}
    for i, sig in rows(members):
        m.setdefault(bytes(sig), set()).add(i)
    pairs = {(min(a, b), max(a, b)) for x, y, *_ in rows(links) for a in m[bytes(x)] for b in m[bytes(y)]}
    pairs |= {(a, b) for s in m.values() for a in s for b in s if a < b}
    return sorted(pairs), members, links


def test_against_brute_force(spark):
    data = records()
    data += [(900 + k, data[0][1], data[0][2]) for k in range(5)]  # copies under other ids
    data += data[:7]  # repeated rows
    got, members, links = found(spark, data)
    want = brute(dict((r[0], r) for r in data).values())
    assert got == want
    g = dict(rows(nd.groups(members, links), "id", "group"))
    for a, b in want:
        assert g[a] == g[b]
    parent = {i: i for i in g}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert g == {i: top(i) for i in g}


def test_a_hot_group(spark):
    base = [f"h{k}" for k in range(80)]
    data = [(k, None, " ".join(base[:k % 20] + [f"x{k}"] + base[k % 20 :])) for k in range(60)]
    assert found(spark, data)[0] == brute(data)


def test_template_with_rare_rest(spark):
    # plain similarity of 0.65 and more, of runs that most records have; what differs is rare and weighs the most
    template = [f"t{k}" for k in range(80)]
    rnd = random.Random(4)
    data = [(k, None, " ".join(template + [f"r{k}x{j}" for j in range(rnd.randrange(14, 26))])) for k in range(60)]
    data += [(100 + k, " ".join(rnd.choices([f"w{j}" for j in range(900)], k=60)), None) for k in range(120)]
    want = brute(data)
    assert len(want) > 500 and found(spark, data)[0] == want


def test_the_threshold_itself(spark):
    # 30 of 50 runs shared make a case, 30 of 51 do not
    base = [f"b{k}" for k in range(32)]
    data = [(k, " ".join(base), " ".join(f"s{k}y{j}" for j in range(12))) for k in range(2)] + [(2, " ".join(base), " ".join(f"s2y{j}" for j in range(13)))]
    data += [(10 + k, None, " ".join(f"s{k % 2}y{j}" for j in range(12)) + " " + " ".join(f"z{k}y{j}" for j in range(40))) for k in range(8)]
    assert found(spark, data)[0] == brute(data) == [(0, 1)]


def test_shared_runs_of_any_frequency(spark):
    # what a pair shares stands in 1, 5 or 20 per cent of the records, what differs nowhere else
    for n in (1000, 4000):
        for share in (0.01, 0.05, 0.2):
            rnd = random.Random(n + int(100 * share))
            size = int(n * share)
            families = [[f"f{k}y{j}" for j in range(70)] for k in range(3)]
            data = []
            for k in range(n):
                if k < 3 * min(size, 60):  # members enough to measure; the other records hold the runs beside much else
                    data.append((k, None, " ".join(families[k % 3] + [f"r{k}x{j}" for j in range(rnd.randrange(10, 17))])))
                else:
                    more = families[k % 3] if k < 3 * size else []
                    data.append((k, " ".join(more), " ".join(f"o{k}x{j}" for j in range(200 if more else 30))))
            few = [r for r in data if r[2] and r[2].startswith("f")]
            want = brute(few)
            got = found(spark, data)[0]
            assert want and not set(got) - set(want)
            assert len(set(got) & set(want)) >= 0.999 * len(want)


def test_weights_are_bounded():
    w = nd.bounded_weights(np.array([1, 10, 1000, 5000]), 1000)
    assert w[0] == np.float32(1.25) and w[2] == w[3] == 1 and 1 < w[1] < 1.25
    assert abs(nd.least_weighted(0.6) - 0.6 / 1.1) < 1e-12


def test_sketch_curve():
    most = most_unequal(0.5, 128, 1e-5)
    rnd = np.random.default_rng(1)
    unequal = rnd.binomial(128, 0.75 * 0.5, 1_000_000)
    assert (unequal > most).mean() <= 2e-5 and (unequal > most - 2).mean() > 1e-5


def test_crowded_bands_are_split(spark):
    bands = spark.createDataFrame([(c, c % 3) for c in range(60)] + [(7, 99), (8, 99), (9, 5)], "cid long, band long")
    want = sorted({(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3} | {(7, 8)}, key=str)
    for crowd in (4, 1000):
        assert rows(nd.banded_pairs(bands, crowd)) == want


def test_edge_cases(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    data = [(1, None, None), (2, "", " "), (3, "a b c", "a b c"), (None, long, None), (4, long, None), (5, None, long.upper()), (6, "…!", "?")]
    assert found(spark, data)[0] == [(4, 5)]
    assert found(spark, [])[0] == []


def test_samples_estimate_weighted_similarity():
    rnd = np.random.default_rng(5)
    keys = np.arange(1, 61, dtype=np.uint64)
    w = rnd.uniform(0.5, 6, 60)
    v = w * rnd.choice([0.5, 1, 1, 2], 60)
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    s = nd.consistent_samples(np.concatenate([keys, keys]), np.concatenate([w, v]), np.array([0, 60]), 3000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_runs_stay_within_texts():
    words, counts = WordHasher()(["a b c d", None, "a b", "", "b c d a b c"])
    assert counts.tolist() == [4, 0, 2, 0, 6]
    found, text = runs(words, counts, 3)
    assert text.tolist() == [0, 0, 4, 4, 4, 4] and found[1] == found[2] and found[0] == found[5] and len(set(found.tolist())) == 4
    keys, n, ends = counted(np.append(found, found[:1]), np.append(text, 0), 5)
    assert ends.tolist() == [0, 2, 2, 2, 2, 6] and sorted(n.tolist()) == [1, 1, 1, 1, 1, 2]

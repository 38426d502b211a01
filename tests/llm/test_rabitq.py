import numpy as np
import pytest

from tagloom.llm import rabitq


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n = len(good)
    link = [[j for j in range(n) if j != i and len(good[i][1]) == len(good[j][1])
             and good[i][1] @ good[j][1] / np.linalg.norm(good[i][1]) / np.linalg.norm(good[j][1]) >= threshold] for i in range(n)]
    comp = {}
    for i in range(n):
        if i in comp:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        for j in seen:
            comp[j] = min(good[k][0] for k in seen)
    out = {i: (0, i) for i, _ in rows}
    for k, (i, _) in enumerate(good):
        out[i] = (len(link[k]), comp[k])
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector int" if len(rows) and len(rows[0]) == 3 else "vec_id long, embedding array<float>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rabitq.near_vectors(df).collect()}


@pytest.mark.parametrize("block", [16, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 32))
    hub = rng.standard_normal(32)
    near = base[:60] + 0.25 * rng.standard_normal((60, 32))
    dense = hub + 0.15 * rng.standard_normal((90, 32))
    x = np.concatenate([base, near, dense, base[:10], base[:3] * 4]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def planted(n, pairs, low, high, seed, d=64):
    """n random vectors and partners of some of them at cosines drawn from low..high."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, d))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(low, high, (pairs, 1))
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c * c) * side]).astype(np.float32)


def test_recall_of_pairs_just_over_the_threshold(spark, capsys):
    """3,000 pairs at 0.90 to 0.92 among 24,000 vectors; every link is known, as all pairs are multiplied."""
    x = planted(21_000, 3_000, 0.9005, 0.92, seed=17)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.zeros(len(x), int)
    for a in range(0, len(x), 2000):
        want[a:a + 2000] = (unit[a:a + 2000] @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rabitq.near_vectors(df).collect()}
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= want).all() and want.sum() >= 6_000
    recall = found.sum() / want.sum()
    with capsys.disabled():
        print(f" recall {recall:.4f} of {want.sum() // 2} links at 0.90 to 0.92")
    assert recall >= 0.97
    linked = [i for i in range(3_000) if found[i] and found[21_000 + i]]
    assert all(got[i][1] == got[21_000 + i][1] for i in linked)


def test_given_vectors_and_planted_partners(spark):
    """The given embeddings hold no link, so partners are added to them."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    rng = np.random.default_rng(3)
    rows += [(10_000 + i, [float(c) for c in np.float32(np.array(v) + 0.04 * rng.standard_normal(len(v)))]) for i, v in rows[:200]]
    got, want = run(spark, rows), brute(rows)
    total = sum(w[0] for w in want.values())
    assert total > 300 and 0.97 * total <= sum(g[0] for g in got.values()) <= total
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98


def test_vectors_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "node_hash", lambda vector: rabitq.F.pmod(rabitq.F.xxhash64(vector), rabitq.F.lit(9)))
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 16))
    x = np.concatenate([x, x[:20] + 0.1 * rng.standard_normal((20, 16)), x[:5]]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want) and sum(g[0] for g in got.values()) == sum(w[0] for w in want.values())


def test_codes_alone_do_not_rule_out_a_pair_at_the_threshold():
    """Of pairs exactly at 0.9 the bits of the codes keep all but a few in a hundred thousand; of unrelated pairs hardly any stays."""
    bits, bands = rabitq.plan_bands(50_000)
    rotations, x = rabitq.Rotations(bits, bands), planted(20_000, 20_000, 0.9, 0.9, seed=5)
    code = rotations.encode(x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True))[0]
    most = rabitq.Undecided(bits, bands, 0.9).most_bits(rotations.matrix(64).shape[0])
    near = np.bitwise_count(code[:20_000] ^ code[20_000:]).sum(axis=1)
    far = np.bitwise_count(code[:20_000] ^ np.roll(code[:20_000], 1, axis=0)).sum(axis=1)
    assert (near <= most).mean() >= 0.9999 and (far <= most).mean() < 0.001


def test_odd_vectors(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1),
            (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [-0.0, 1.0], 1), (12, [0.0, 1.0], 1)]
    got = run(spark, rows)
    assert {i: got[i][:2] for i in range(1, 7)} == {i: (0, i) for i in range(1, 7)}
    assert got[10][:2] == (0, 10)
    assert got[7][1] == got[8][1] == got[9][1] == 7 and got[9][0] >= 1
    assert got[11][1] == got[12][1]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rabitq.near_vectors(empty).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotations = rabitq.Rotations(8, 8)
    code, factor, _ = rotations.encode(x)
    turned = x @ rotations.matrix(64)[:64].T
    estimate, bound = rabitq.estimate_and_bound(turned, np.unpackbits(code, axis=1, count=64) * 2.0 - 1, factor)
    error = estimate - x @ x.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= bound).mean() > 0.999

"""SetSketch near-duplicates against all pairs by Python sets; mergeability and the joint estimate."""

import random
import re

import numpy as np
import pyarrow as pa

from foliospark.llm import jaccard, setsketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and top(j) == top(i) and rows[j][0] is not None] if sets[i] else [doc_id]
        component = min(ids, default=None)
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def rows_of(seed=11):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "one two"), (None, "one two three"), (None, None), (None, "alone here in this text")]
    shared = fresh(60)
    for _ in range(25):
        base = fresh(rng.choice([6, 20, 80, 300]))
        rows += [(len(rows), edited(rng, base, rng.choice([0, 1, 2, 3, len(base) // 20, len(base) // 8]))) for _ in range(rng.randrange(1, 8))]
        rows.append((len(rows), " ".join(shared + fresh(40))))
    chain = fresh(200)
    for _ in range(30):  # a chain whose ends are unlike
        chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(chain)))
    return [*rows, rows[-1], rows[20], rows[20]]


def test_near_duplicates_against_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, registers string, n int")
    out = setsketch.near_duplicates(df, 4, 4, 5)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows, 4, 4, 5)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 60


def test_no_documents(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_bands_and_blocks(spark, monkeypatch):
    """A band of more sets than one task compares, and a component of several blocks."""
    for module in (setsketch, jaccard):
        monkeypatch.setattr(module, "LIST_SETS", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 3)) for i in range(60)] + [(100 + i, edited(rng, base, 40)) for i in range(20)]
    out = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 4, 5)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 4, 4, 5)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b = pool[:1800], pool[200:2000]
    x, y, both, none = setsketch.sketches([a, b, np.union1d(a, b), pool[:0]])
    assert (setsketch.merge(x, y) == both).all() and not none.any() and (setsketch.sketches([a])[0] == x).all()
    m = len(x)
    args = lambda p, q: (np.array([(p > q).sum()]), np.array([(p < q).sum()]), m)
    n = np.array([1800.0])
    assert abs(setsketch.estimate(*args(x, y), n, n)[0] - 0.8) < 0.15
    assert setsketch.estimate(*args(x, x), n, n)[0] > 0.999
    single = [np.array([t], np.uint64) for t in pool[:200]]
    assert (setsketch.sketches(single) > 0).all()
    exact = [setsketch.sketches([pool[i : i + 900], pool[i + 100 : i + 1000]]) for i in range(0, 2000, 50)]
    equal = np.mean([(p == q).mean() for p, q in exact])
    assert abs(equal - 0.8) < 0.02  # a register is equal as often as the sets are alike


def test_sketches_do_not_depend_on_the_batch():
    texts = pa.array([t for _, t in rows_of()])
    sets = list(jaccard.shingle_sets(texts, 4))
    assert (setsketch.sketches(sets) == np.concatenate([setsketch.sketches([s]) for s in sets])).all()

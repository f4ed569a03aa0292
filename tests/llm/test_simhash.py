"""SimHash groups against all pairs."""
import random

import numpy as np
import pytest
import xxhash
from noteloom.llm import simhash
from noteloom.llm.components import components, unite


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return sorted((str(doc), f"{fp:016x}", least.get(x)) for (doc, _), fp, x in zip(rows, fps, label))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 499, " ".join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, rows[0][1]), (904, rows[0][1]), (None, rows[1][1]), (None, "nobody else says this")]


@pytest.mark.parametrize(("seed", "most"), [(0, 4096), (1, 3), (2, 10)])
def test_groups(spark, seed, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs, most=most).collect()
    assert sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in got), key=str) == sorted(groups(rows), key=str)


def test_fingerprints_of_long_texts(monkeypatch):
    """Stretches of shingles change nothing."""
    r = random.Random(2)
    text = " ".join(f"W{r.randrange(50)}" for _ in range(3000))
    want = fingerprint(text)
    for rows in (1, 7, 2997, 1 << 14):
        monkeypatch.setattr(simhash, "_ROWS", rows)
        assert simhash.fingerprint(text) == want


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 20).astype(np.uint64)
    values = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(30)]))
    rng.shuffle(values)
    group = rng.integers(0, 3, len(values))
    near = (np.bitwise_count(values[:, None] ^ values[None]) <= 4) & (group[:, None] == group[None]) & ~np.eye(len(values), dtype=bool)
    q, other = simhash.BKForest(values, group).within(np.arange(len(values)), 4)
    assert sorted(zip(q.tolist(), other.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))
    assert np.array_equal(simhash.stars(values, group, 4, frontier=50), unite(np.arange(len(values)), *np.nonzero(near)))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(159, 99), (7, 7), (200, 300), (300, 200)]
    links += links[:5]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 99 for i in range(99, 160)} | {200: 200, 300: 200}


def test_keep_one(spark):
    rows = [(5, "a b c d e", 1), (3, "a b c d e", 2), (9, "z y x w v", 3), (None, "a b c d e", 4), (3, "a b c d e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component_id for r in kept.collect()) == [2, 3, 4, 5]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize(("seed", "many", "most"), [(0, 512, 4096), (1, 5, 5), (1, 5, 4096)])
def test_copies_by_similarity(spark, seed, many, most):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(150):
        base = [r.choice(vocab) for _ in range(r.randint(60, 400))]
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8, 16, 30])):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        pairs.append((2 * i, 2 * i + 1, jaccard(rows[-2][1], rows[-1][1])))
    line = "one line that stands in very many of the documents and says nothing"
    rows = [(i, f"{t} {line}" if i % 3 else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs, many=many, most=most).collect()}
    assert len(got) == len(rows)
    text = dict(rows)
    pairs = [(a, b, jaccard(text[a], text[b])) for a, b, _ in pairs]
    sure = [got[a] == got[b] for a, b, j in pairs if j >= 0.85]
    assert sum(sure) >= 0.97 * len(sure) > 20
    assert not any(got[a] == got[b] for a, b, j in pairs if j < 0.6)
    # Texts of different pairs never meet.
    assert all(i // 2 == c // 2 for i, c in got.items())


def repeated_line(r, k):
    """Two texts of 28 lines, alike but that one repeats a line k times."""
    lines = [" ".join(f"v{r.randrange(10**6)}" for _ in range(12)) for _ in range(28)]
    line = " ".join(f"v{r.randrange(10**6)}" for _ in range(12))
    return "\n".join([*lines, line]), "\n".join([*lines, *[line] * k])


def test_copies_that_repeat_a_line(spark):
    r = random.Random(4)
    pairs = [repeated_line(r, k) for k in (6, 10, 14, 20) for _ in range(25)]
    assert all(jaccard(*p) >= 0.95 for p in pairs)
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_fingerprints_of_copies_lie_within_the_radius():
    rng = np.random.default_rng(6)
    far = []
    for n in (46, 100, 300) * 700:
        h = rng.integers(0, 2**63, 2 * n, np.uint64)
        both = -(-8 * n // 9)
        a, b = h[:n], np.concatenate([h[:both], h[n : 2 * n - both]])
        far.append((simhash.majority(iter([a])) ^ simhash.majority(iter([b]))).bit_count())
    assert np.mean(np.array(far) <= simhash.WIDE) >= 0.999


@pytest.mark.parametrize("together", [1024, 20])
def test_copies_at_the_edge(spark, together):
    r = random.Random(9)
    rows, want = [], []
    for i in range(400):
        n = r.choice([50, 60, 120, 300])
        base = [f"v{r.randrange(10**6)}" for _ in range(n)]
        edge = r.uniform(0.75, 0.85)
        copy = [*base[: round(n * edge)], *(f"u{r.randrange(10**6)}" for _ in range(r.choice([0, n // 40])))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want.append(jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    # A family of texts whose neighbours alone are copies.
    long = [f"x{r.randrange(10**6)}" for _ in range(400)]
    rows += [(1000 + k, " ".join(long[12 * k : 12 * k + 124])) for k in range(22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs, together=together).collect()}
    assert 100 < sum(want) < 300
    linked = [got[2 * i] == got[2 * i + 1] for i in range(400)]
    assert not any(x and not y for x, y in zip(linked, want))
    assert sum(x and y for x, y in zip(linked, want)) >= sum(want) - 1
    assert {got[1000 + k] for k in range(22)} == {1000}


def test_families_of_a_large_cluster(spark):
    """Clusters dealt in blocks: two families with a bridge, a chain, and texts that only candidates tie to them."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(200)]

    def edited(words, n):
        out = list(words)
        for at in r.sample(range(len(out)), n):
            out[at] = word()
        return out

    second = base[:150] + [word() for _ in range(50)]
    bridge = base[:150] + [*base[150:178], *second[178:]]
    texts = [edited(base, 1) for _ in range(60)] + [edited(second, 1) for _ in range(30)] + [bridge]
    texts += [edited(base, k) for k in (4, 6, 8, 12, 20, 30)] + [[*base[: 200 - k], *(word() for _ in range(k))] for k in (10, 20, 30, 60)]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    clusters = spark.createDataFrame([(i, 0) for i, _ in rows], "node long, component long")
    marks = [(simhash.mark(simhash.shingle_set(t)), i, len(simhash.shingle_set(t))) for i, t in rows]
    nodes = spark.createDataFrame(marks, "mark long, node long, n long")
    simhash.ensure_checkpoint_dir(spark)
    assert len(set(label)) > 2
    for together in (1024, 16, 5):
        found = {x.node: x.component for x in components(simhash.verified(docs, nodes, clusters, together=together)).collect()}
        assert [found.get(i, i) for i, _ in rows] == label


def test_alike_equals_all_pairs():
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 2**63, 40, np.uint64) for _ in range(12)]
    sets = [np.unique(np.where(rng.random(40) < rng.uniform(0, 0.2), rng.integers(0, 2**63, 40, np.uint64), base[rng.integers(12)])) for _ in range(200)]
    sets += [np.zeros(0, np.uint64), sets[0][:33]]
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(x) for x in sets])
    near = common >= 0.8 * (size[:, None] + size[None] - common)
    assert np.array_equal(simhash.alike(sets), unite(np.arange(len(sets)), *np.nonzero(near)))


@pytest.mark.parametrize("most", [40, 4096])
def test_copies_that_meet_only_in_hot_buckets(spark, most):
    """Copies of which no two neighbouring least hashes agree, and whose common ones very many share."""
    r = random.Random(12)
    line = [f"z{k}" for k in range(60)]
    usual = simhash.sketch(simhash.shingle_set(" ".join(line)))[1]
    rows = []
    while len(rows) < 80:
        base = [f"q{r.randrange(10**6)}" for _ in range(40)]
        copy = list(base)
        for at in (r.randrange(5, 18), r.randrange(23, 35)):
            copy[at] = "other"
        a, b = (" ".join([*line, *x]) for x in (base, copy))
        x, y = (simhash.sketch(simhash.shingle_set(t))[1] for t in (a, b))
        same = [k for k in range(simhash.KEYS) if x[k] == y[k]]
        if same and all(x[k] == usual[k] and (k + 1) % simhash.KEYS not in same for k in same) and jaccard(a, b) >= 0.8:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    rows += [(1000 + i, " ".join([*line, *(f"q{r.randrange(10**6)}" for _ in range(40))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs, many=40, most=most).collect()}
    assert got == {i: i - i % 2 if i < 80 else i for i, _ in rows}

"""Personal data, decontamination and the quality network: plain versions, held-out accuracy, edge cases."""
import hashlib
import itertools
import random
import zlib
import re

import numpy as np
import pytest
from noteloom.llm import byte_cnn, decontaminate, pii

# ---- personal data ------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    None, "", "nothing here", "mail a.b+c@x-y.example.org, or @x.y or a@b or a@@b.c d@e.f@g.h", "1.2.3.4 1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3 9999.1.1.1.1 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 x 0000000000000 12345", "+1 (988) 555-2485 +123 +1 2 3 4 5 6 7 8 9 +44.20.7946.0958 ++4420794609581234567", "é日本🎉 a@b.cd 🎉 1.1.1.1 +49 30 123456 4000 0000 0000 0002", "a@b.c" * 50, "9" * 3000, ".".join("1" * 500), "+" * 200 + "1 " * 100,
    "write to jo (at) example.org or call (415) 555-0132 now", 'token = "9f86d081884c7d659a2feaa0c55ad015" and 4111111111111111',
]


def plain_base(text):
    text, out = text or "", []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(PERSONAL)] + [(3, PERSONAL[3], "y"), (None, PERSONAL[4], "z")]
    got = pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)).collect()
    want = []
    for i, t, _ in rows:
        spans = plain_base(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want.append((i, *(sum(s[0] == k for s in spans) for k in PATTERNS), digest))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        found = {tuple(x.split(":")) for x in r.spans.split(",") if x}
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert {(k, str(a), str(b)) for k, a, b in plain_base(text)} <= found
        ordered = [(pii.KINDS.index(k), int(a)) for k, a, _ in (x.split(":") for x in r.spans.split(",") if x)]
        assert ordered == sorted(ordered)


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_of_random_texts(seed):
    r = random.Random(seed)
    for _ in range(400):
        text = "".join(r.choice("0123456789..--  ()+@ab@.") for _ in range(r.randint(0, 60)))
        got = [(k, a, b) for k, v in pii.pattern_spans(text).items() for a, b in v]
        assert got == plain_base(text), text


def test_field_adds_spans_in_unseen_words():
    model = pii.Field.fit()
    texts = ["Ring (303) 555-0121 tonight", "mail karla.b (at) firm.example please", "host 2001:db8:7:8:9:a:b:c fell", "token = 1f2e3d4c5b6a79880123456789abcdef", "in 1998 we sold 25 boxes at 3 for 12.50", "am 24.12.2023 um 18 Uhr 30"]
    found = [{k for part in f for k, v in part.items() if v} for f in pii.find(texts, model)]
    assert found == [{"phone"}, {"email"}, {"ip"}, {"secret"}, set(), set()]


def test_long_runs_and_tokens_are_read_whole():
    model = pii.Field.fit()
    r = random.Random(1)
    tokens = [r.choice(["call", "415-555-0198", "(at)", "jo", "example.org", "12", "token=", "9f86d081884c7d659a2feaa0c55ad015", "at", "x@", "2001:db8:7:8:9:a:b:c"]) for _ in range(10_000)]
    one = model.decode([tokens])[0]
    # A plain Viterbi over the whole run.
    e = np.array([model.emit[[model.names.get(n, len(model.names)) for n in f]].sum(axis=0) for f in pii.features(tokens)])
    step, best, backs = model.step + model.allowed, e[0] + model.start, []
    for row in e[1:]:
        scores = best[:, None] + step
        backs.append(scores.argmax(axis=0))
        best = scores.max(axis=0) + row
    path = [int(best.argmax())]
    for back in reversed(backs):
        path.append(int(back[path[-1]]))
    assert one.tolist() == path[::-1]
    mixed = [["call", "415-555-0198"], tokens, [], tokens[:5000], ["x"]]
    assert [y.tolist() for y in model.decode(mixed)] == [model.decode([s])[0].tolist() for s in mixed]
    # What follows the first characters of a token counts.
    assert pii.shape("a" * 1000) != pii.shape("a" * 999 + "1")
    long = "call " + "(" * 80 + "415) 555-0198"
    assert pii.shape(long.split()[1]) == "((ddd)"
    base, added = pii.find(["+1 415 555 0198 " * 2000 + "write to jo (at) example.org or call (415) 555-0132 now"], model)[0]
    assert len(base["phone"]) >= 1000
    assert added["email"]


def test_added_spans_touch_no_others():
    model = pii.Field.fit()
    r = random.Random(2)
    parts = ["4111 1111 1111 1111", "+1 415 555 0198", "call (415) 555-0132", "jo (at) example.org", "a@b.cd", "1.2.3.4", "x", "token=9f86d081884c7d659a2feaa0c55ad015", "12 34 56 78 90"]
    for _ in range(200):
        text = " ".join(r.choice(parts) for _ in range(30))
        base, added = pii.find([text], model)[0]
        assert sorted((k, *s) for k, v in base.items() for s in v) == sorted(plain_base(text))
        new = sorted(s for v in added.values() for s in v)
        assert all(a[1] <= b[0] for a, b in zip(new, new[1:]))
        assert all(b <= c or d <= a for a, b in new for v in base.values() for c, d in v)


def test_viterbi_is_the_best_path():
    model, rng = pii.Field.fit(epochs=5), np.random.default_rng(0)
    runs = [["call", "415-555-0198"], ["x"], [], ["at", "10", "(at)"]]
    model.emit += rng.normal(0, 1, model.emit.shape)
    for tokens, got in zip(runs, model.decode(runs)):
        if not tokens:
            assert len(got) == 0
            continue
        e = [model.emit[[model.names.get(n, len(model.names)) for n in f]].sum(axis=0) for f in pii.features(tokens)]
        step = model.step + model.allowed
        score = lambda y: model.start[y[0]] + sum(e[k][y[k]] for k in range(len(y))) + sum(step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(score(y) for y in itertools.product(range(model.n), repeat=len(tokens)))
        assert score(got.tolist()) == pytest.approx(best)


def test_redact(spark):
    rows = [(1, "mail a@b.cd or +1 (988) 555-2485.", 33), (2, None, 0), (3, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted([(1, "mail [EMAIL] or [PHONE].", 24), (2, None, 0), (3, "clean", 5)])
    assert pii.redact(docs.limit(0)).collect() == []
    assert pii.pii_spans(docs.limit(0)).collect() == []


# ---- decontamination ----------------------------------------------------------------
def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        new = [i]
        for j in range(1, len(text) + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (item[i - 1] != text[j - 1])))
        row = new
    return min(row)


def test_closest_is_the_edit_distance():
    r = random.Random(0)
    for _ in range(500):
        item = [r.randint(1, 4) for _ in range(r.randint(1, 70))]
        text = [r.randint(1, 4) for _ in range(r.randint(0, 40))]
        assert decontaminate.closest(item, text) == plain_distance(item, text)


def contaminated_corpus(seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfghkl" for b in ("a", "e", "i", "an", "or", "ut")]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([5, 9, 15, 22, 40, 60])))) for i in range(14)] + [(50, None), (51, ""), (52, "two words"), (53, "Same, item! said again and again"), (54, "same item said again and again")]
    docs = []
    for i in range(90):
        body = text(r.randint(0, 90))
        if r.random() < 0.6:
            words = (r.choice(items[:14])[1]).split()
            for _ in range(r.randint(0, int(0.3 * len(words)))):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = ["other"] * r.randint(0, 1)
            at = r.randint(0, len(body))
            body[at:at] = words
        docs.append((i, " ".join(body)))
    return items, docs + [(200, None), (201, ""), (3, docs[3][1]), (None, "x " + items[4][1].upper() + " y"), (202, "SAME item; said -- again and again?")]


@pytest.mark.parametrize("seed", range(3))
def test_matches(spark, seed):
    items, rows = contaminated_corpus(seed)
    want = []
    for d, text in rows:
        tokens = decontaminate.words(text or "")
        for i, item in items:
            w = decontaminate.words(item or "")
            if len(w) >= 5 and (e := plain_distance(w, tokens)) <= int(0.2 * len(w) + 1e-9):
                want.append((d, i, e))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.matches(docs, bench).collect()]
    assert set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)
    # Exact copies share every key.
    assert {x for x in want if x[2] == 0} <= set(got)
    blocks = [tuple(r) for r in decontaminate.matches(docs, bench, block=4).collect()]
    assert set(blocks) <= set(want)
    assert len(blocks) >= 0.9 * len(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {x[0] for x in got}


def test_recall_holds_for_each_length():
    """Short items and long ones together: edited copies at the greatest distance are found among both."""
    r = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bcdfghkl" for b in "aeiou" for c in "mnprst"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(5))) for i in range(320)] + [(1000 + i, " ".join(text(40))) for i in range(400)]
    index = decontaminate.Index(items)
    assert set(index.recall) == {5, 40}
    assert min(index.recall.values()) >= decontaminate.RECALL
    for n, low in ((5, 0), (40, 1000)):
        copies, of = [], []
        while len(copies) < 200:
            i, item = r.choice([x for x in items if (x[0] >= 1000) == bool(low)])
            copy = item.split()
            for _ in range(index.edits(n)):
                at, kind = r.randrange(len(copy)), r.randrange(3)
                copy[at : at + (kind != 1)] = ["other"] * (kind != 2)
            if plain_distance(item.split(), copy) == index.edits(n):
                copies.append(" ".join([*text(20), *copy, *text(20)]))
                of.append(i)
        found = {(d, i) for d, i, _ in index.search(copies)}
        assert sum((d, i) in found for d, i in enumerate(of)) >= 0.93 * len(of)


def test_lengths_that_no_walks_reach_are_searched_exhaustively(monkeypatch):
    items, rows = contaminated_corpus(5)
    texts = [t or "" for _, t in rows]
    want = []
    for d, text in enumerate(texts):
        for i, item in items:
            w = decontaminate.words(item or "")
            if len(w) >= 5 and (e := plain_distance(w, decontaminate.words(text))) <= int(0.2 * len(w) + 1e-9):
                want.append((d, i, e))
    index = decontaminate.Index(items, recall=1.01)
    assert not any(index.walks.values())
    assert [x for x in index.search(texts) if x[1] != 52] == sorted(want)


def test_equal_items_are_searched_once(spark):
    items = [(i, "the very same item said by all of them") for i in range(50)] + [(None, "the very same item said by all of them"), (60, "another item that nobody else has here"), (61, None), (62, "short one"), (63, "short one")]
    docs = spark.createDataFrame([(1, "x the very same item said by all of them y"), (2, "another item that nobody else has here"), (3, "a short one")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = sorted(map(tuple, decontaminate.matches(docs, bench, block=2, together=1).collect()), key=str)
    assert got == sorted([(1, i, 0) for i in [*range(50), None]] + [(2, 60, 0), (3, 62, 0), (3, 63, 0)], key=str)
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.matches(docs.limit(0), bench).collect() == []
    assert decontaminate.matches(docs, bench.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 1
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


# ---- quality network ----------------------------------------------------------------
def labelled_texts(n):
    r = random.Random(4)
    out = []
    for i in range(n):
        words = ["".join(r.choice("aeioudnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(8, 60))]
        bad = i % 4 == 0
        out.append((i, " ".join(w + "###" if bad else w for w in words), 0 if bad else 1))
    return out


def test_network_separates_held_out_documents(spark):
    rows = labelled_texts(240)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "aa ee dd", "x"), (3, rows[3][1], "y")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = byte_cnn.score_documents(docs, labels, epochs=8).collect()
    assert len(got) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    quality = dict((i, q) for i, _, q in rows)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 20
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.95
    again = {(r.doc_id, r.score) for r in byte_cnn.score_documents(docs.repartition(5), labels, epochs=8).collect()}
    assert {(i, round(s, 5)) for i, s in again} == {(r.doc_id, round(r.score, 5)) for r in got}


def test_pooling_does_not_depend_on_chunks():
    net, rng = byte_cnn.Network(), np.random.default_rng(1)
    for n in (1, 3, 6, 7, 100, 1000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        assert np.allclose(net.pool(data, 10), net.pool(data, 1 << 20), atol=1e-5)
    assert not net.pool(np.zeros(0, np.uint8)).any()


def test_pooling_is_a_plain_convolution():
    net, rng = byte_cnn.Network(), np.random.default_rng(3)
    table = net.p["table"]
    for n in (6, 9, 50):
        data = rng.integers(0, 256, n).astype(np.uint8)
        rows = [[max(0.0, float(net.p["offset"][f] + sum(table[k][data[i + k], f] for k in range(byte_cnn.WIDTH)))) for f in range(byte_cnn.FILTERS)] for i in range(n - byte_cnn.WIDTH + 1)]
        columns = list(zip(*rows))
        assert np.allclose(net.pool(data, 4), [*map(max, columns), *(sum(c) / len(c) for c in columns)], atol=1e-5)
        hidden = [max(0.0, float(sum(p * w for p, w in zip(net.pool(data), net.p["w1"][:, j])) + net.p["b1"][j])) for j in range(byte_cnn.HIDDEN)]
        score = 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.p["w2"])) + net.p["b2"][0])))
        assert net.score([data])[0] == pytest.approx(score, abs=1e-4)


def test_training_reads_whole_texts(spark):
    """Long texts differ in their last bytes only; gradients of chunks are those of the whole; a bound in bytes leaves out whole texts."""
    rng = np.random.default_rng(5)
    net, texts = byte_cnn.Network(), [rng.integers(97, 123, n).astype(np.uint8) for n in (700, 6, 2, 90)]
    y, w = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 1.0, 0.5])
    whole, parts = net.gradients(texts, y, w)[0], net.gradients(texts, y, w, chunk=64)[0]
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)
    rows = [(i, "word " * 4000 + ("good end" if i % 2 else "#@!#@!#@"), i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = byte_cnn.score_documents(docs, labels, epochs=30).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9
    assert byte_cnn.train(docs, labels, most=100, epochs=1) is not None
    assert byte_cnn.train(docs, labels, most=50_000, epochs=1) is not None


def test_a_text_beyond_the_byte_bound_takes_no_other_away(spark):
    """One labelled text that is longer than all bytes allowed is left out; the others are learned from as before."""
    assert byte_cnn.fitting([4, 2, 9, 7], [50, 500, 30, 30], 100) == [4, 9] and byte_cnn.fitting([4, 2], [500, 300], 100) == [2] and byte_cnn.fitting([], [], 100) == []
    rows = labelled_texts(240)
    longest = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5][:20]  # some of these come before any other by hash
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(k, "word ### " * 20_000) for k in longest], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(k, 1) for k in longest], "doc_id long, quality int")
    net = byte_cnn.train(docs, labels, epochs=8, most=150_000)
    held = [(t, q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    score = net.score([np.frombuffer(t.encode(), np.uint8) for t, _ in held])
    assert np.mean((score >= 0.3) == np.array([q for _, q in held])) > 0.95


def test_added_cards_and_secrets():
    """An added card passes Luhn, as those of the patterns do; a secret ends at its quote."""
    assert not pii._plausible("card", "4111111111111112") and pii._plausible("card", "4111.1111.1111.1111")
    text = 'api_key="A1b2C3d4E5f6G7h8I9"###'
    assert text[slice(*pii.trimmed(text, "secret", 0, len(text)))] == "A1b2C3d4E5f6G7h8I9"


def test_gradients_follow_the_loss():
    net, rng = byte_cnn.Network(), np.random.default_rng(2)
    texts = [rng.integers(97, 105, n).astype(np.uint8) for n in (3, 20, 40)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradients(texts, y, w)
    for name, at in (("table", (2, 100, 3)), ("offset", (5,)), ("w1", (3, 4)), ("w1", (20, 2)), ("w2", (1,)), ("b2", (0,))):
        p, e = net.p[name], 1e-5
        p[at] += e
        up = net.gradients(texts, y, w)[1]
        p[at] -= 2 * e
        down = net.gradients(texts, y, w)[1]
        p[at] += e
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in byte_cnn.score_documents(docs, labels).collect()] == [0.5]
    assert byte_cnn.score_documents(docs.limit(0), labels).collect() == []

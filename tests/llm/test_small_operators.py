"""Quality rules, BPE, sharding and HTML extraction against plain versions, and edge cases of all."""
import hashlib
import random
from collections import Counter

import pytest
import tiktoken
from noteloom.llm import bpe, decontaminate, html_text, quality_rules, sharding
from noteloom.llm.common import pieces

TEXTS = [None, "", " \n\t", "word", "a b c " * 40, "é ü 日本 🎉 " * 30, "line one is here\n" * 30, "# $ % & | < > *" * 20, "UPPER CASE WORDS ARE HERE " * 20, "x" * 5000, "tab\tvt\x0bff\x0cfs\x1cnel\x85nbsp\xa0 end " * 20]
CLEAN = " ".join(f"word{i} other{i * 7}" for i in range(60))


def docs_of(spark, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(1, texts[1], "y", 0), (None, CLEAN, "z", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int").repartition(2)


def plain_counts(text):
    text = text or ""
    blank = set(" \t\n\x0b\x0c\r")
    words, cur = [], ""
    for c in text:
        if c in blank:
            words, cur = (words + [cur] if cur else words), ""
        else:
            cur += c
    words += [cur] if cur else []
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in blank for c in line):
            dup += line in seen
            seen.add(line)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), n < 50 or 100 * len(again) > 50 * n)


def test_quality_counts(spark):
    rows, docs = docs_of(spark, [*TEXTS, CLEAN, CLEAN + "\n" + CLEAN])
    got = quality_rules.quality_verdicts(docs).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((i, *plain_counts(t)) for i, t, _, _ in rows), key=key)
    assert {r.doc_id for r in got if r.kept} == {len(TEXTS), None}
    assert not any(r.kept and r.base_failed for r in got)


def test_cascade_order_keeps_verdicts(spark):
    rows, docs = docs_of(spark, [*TEXTS, CLEAN])
    order = quality_rules.cascade_order(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
    for text in [*TEXTS, CLEAN]:
        f = quality_rules.Facts(text or "")
        assert quality_rules.passes(f, order) == quality_rules.passes(f, quality_rules.RULES)
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(len(TEXTS)), "None"])
    assert quality_rules.quality_filter(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def plain_bpe():
    c = bpe.Codec(bpe.RANKS, bpe.PATTERN)
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks={b: i for i, b in enumerate(c.bytes_of) if b}, special_tokens={})


@pytest.mark.parametrize("seed", range(4))
def test_bpe_cuts_change_nothing(plain_bpe, seed):
    r = random.Random(seed)
    c = bpe.Codec(bpe.RANKS, bpe.PATTERN)
    for _ in range(60):
        text = "".join(r.choice(["a", "Zz", " ", "  ", "\n", "\t", "'s", "'", "9", "12", "é", "日本", "\x1c", "\x85", "\xa0", "　", "!", "?!", "<|endoftext|>", "🎉", "\r\n"]) for _ in range(r.randint(0, 80)))
        for long in (1, 3, 17, 1000):
            parts = bpe.cut_safely(text, long)
            assert "".join(parts) == text
            ids = c.encode(text, long)
            assert ids == plain_bpe.encode_ordinary(text)
            assert c.decode(ids) == text.encode()


def test_bpe_digests(spark, plain_bpe):
    rows, docs = docs_of(spark, [*TEXTS, CLEAN])
    got = bpe.bpe_digests(docs).collect()
    want = []
    for i, t, _, _ in rows:
        ids = plain_bpe.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_of_an_empty_table(spark):
    _, docs = docs_of(spark, TEXTS)
    assert bpe.bpe_digests(docs.limit(0)).collect() == []
    assert bpe.bpe_encode(docs.limit(0)).collect() == []


def test_bpe_without_language(spark):
    docs = spark.createDataFrame([("one two", 1, 5), (None, None, 6)], "text string, doc_id long, ids long")
    got = {r.doc_id: r for r in bpe.bpe_encode(docs).collect()}
    assert (got[1].n_tokens, got[1].lang, got[None].ids) == (2, None, [])


def test_bpe_round_trip(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    back = {r.doc_id: bytes(r.bytes) for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t, _, _ in rows}


@pytest.mark.parametrize(("limit", "seed"), [(10, 0), (300, 1), (5000, 2), (10**9, 3)])
def test_sharding(spark, limit, seed):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.9 else 4, "x" * r.choice([0, 1, 20, 400])) for i in range(200)] + [(None, "é" * 30), (None, None), (7, None)]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, shard string").repartition(3)
    got = sharding.shards(docs, limit).collect()
    assert sorted(((x.doc_id, x.n_bytes) for x in got), key=str) == sorted(((i, len((t or "").encode())) for i, t in rows), key=str)

    def bits(i):
        return bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)

    def split(members, depth):
        total = sum(n for _, n in members)
        if total <= limit or depth == 60:
            return [(members, depth, total)]
        return [x for bit in "01" if (half := [m for m in members if bits(m[0])[depth] == bit]) for x in split(half, depth + 1)]

    want = [(str(i), n, bits(i)[:d], d, len(members), total, total <= limit) for members, d, total in split([(i, len((t or "").encode())) for i, t in rows], 0) for i, n in members]
    assert sorted((str(x.doc_id), x.n_bytes, x.shard, x.depth, x.shard_docs, x.shard_bytes, x.fits) for x in got) == sorted(want)
    assert sharding.shards(docs.limit(0), limit).collect() == []


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words without any markup", "plain words without any markup"),
    ("<body><p>plain</p></body>", "plain"),
    ("<body><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></body>", ""),
    ("<article><p>a</p><p></p><p> b&amp;c&nbsp;d </p></article>", "a\n\nb&c d"),
    ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>x<b>y</b> z<br>w<p>v</article><footer>f</footer>", "T\n\nxy z w\n\nv"),
    ("<div class='ad'>buy<article><p>in</p></article>", "in"),
    ("<article><p>one</p><aside>side</aside><form><input>f</form><div class=\"cookie-notice\">n</div><p>two</p></article><section id=comments><article class=comment><p>hi</p></article></section>", "one\n\ntwo"),
    ("<script>var t='</p><article>';</script><style>p{}</style><article><p title='a>b'>t &lt;b&gt;</p><!-- <p>no</p> --></article>", "t <b>"),
    ("<article><p>one <span class='ad'>buy <b>now</b></span> two <button>press</button>three</p><span class=promo>x<p>y</p>z</span><p>four</p></article>", "one two three\n\nfour"),
    ("<ARTICLE><P>Upper</P><script>never closed", "Upper"),
    ("<body><div class=menu><a>x</a></div><div><p>" + "long text " * 20 + "</p><p>short</p></div><div class=comments><p>" + "reader says " * 20 + "</p></div></body>", ("long text " * 20).strip() + "\n\nshort"),
    ("<article><p>&#233;&eacute;&#x1F389; &unknown;</p></article>", "éé🎉 &unknown;"),
    # End tags that are left out or missing.
    ("<article><p class=ad>buy<p>real one<p>real two</article>", "real one\n\nreal two"),
    ("<article><ul><li class=promo>buy<li>x<li>y</ul></article>", "x\n\ny"),
    ("<article><div class='ad'>buy<p>one</p><p>two</p></article>", "one\n\ntwo"),
    ("<div class=sidebar><p>s</p><section><article><p>in</p></div><p>after</p>", "in"),
    ("<article><p>a</p><nav><ul><li>m</ul><p>b</article>", "a\n\nb"),
    ("<article><p>one<title>never closed<p>two</article>", "one\n\ntwo"),
    ("<article><table><tr><td class=ad>buy<td>c1<td>c2<tr><td>c3</table><dl><dt>t<dd>d</dl></article>", "c1\n\nc2\n\nc3\n\nt\n\nd"),
    # The article's own header, and words of a class that tell of its subject.
    ("<body><header><p>Site</p></header><article><header class=page-header><h1 class=header>The Title</h1></header><p>x</p><footer>tags</footer></article>", "The Title\n\nx"),
    ("<article><div class='related-work'>r</div><p class='social-history'>s</p><div class='search-results'>q</div><math><mi>x</mi></math></article>", "r\n\ns\n\nq\n\nx"),
    ("<article><p>a</p><div class='related-posts'>r</div><ul class='post-share'><li>s</ul><div class='ad-container'>b</div><div class='has-sidebar'>k</div></article>", "a\n\nk"),
    # A form or a class around everything, and a teaser beside much text.
    ("<form><div class='modal'><article><p>in</p></article></div></form>", "in"),
    ("<form><h1>Title</h1><p>text</p></form>", "Title\n\ntext"),
    ("<article><p>teaser</p></article><div>" + "<p>much longer text of the page</p>" * 6 + "</div>", "teaser" + "\n\nmuch longer text of the page" * 6),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


def plain_choice(weights, least, window):
    """By definition: a line with weight stays if, looking over the windows to either side up to the next without weight, one is above the threshold."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out = []
    for i, w in enumerate(weights):
        low = high = i
        while low and sums[low - 1]:
            low -= 1
        while high + 1 < len(sums) and sums[high + 1]:
            high += 1
        if w and any(x > least for x in sums[low : high + 1]):
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_distribution_like_the_plain_one(seed):
    r = random.Random(seed)
    for _ in range(200):
        weights = [r.choice([0, 0, 0, 1, 7, 50, 300]) for _ in range(r.randint(0, 40))]
        window, least = r.randint(1, 5), r.choice([0.1, 6, 30, 60, 200])
        assert html_text.kept(html_text.np.array(weights, float), least, window) == plain_choice(weights, least, window)


def random_page(r, article):
    """A page, and its lines with what the method knows of each: text, weight, whether in the article."""
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    known, out = [], ["<html><head><title>t</title><style>p{}</style></head><body>"]

    def line(tag, n, weigh=True, inside=False, attributes="", end=True):
        t = words(n)
        known.append((t, len(t) if weigh else 0, inside))
        out.append(f"<{tag}{attributes}>" + t.replace(" ", r.choice([" ", "\n", " <b>", "  "]), 1) + (f"</{tag}>" if end else ""))

    def rest():
        for _ in range(r.randint(0, 4)):
            out.append(r.choice(["<nav>", "<aside>", "<div class='cookie banner'>", "<section id=comments>", "<footer>", "<form>"]))
            close = out[-1][1:].split(">")[0].split(" ")[0]
            for _ in range(r.randint(1, 4)):
                line("p", r.randint(1, 30), weigh=False)
            out.append(f"</{close}><script>if (a < b) '</p>'</script>")

    rest()
    if article:
        known.extend([("", 0, False)] * html_text.WINDOW)
        out.append("<article>")
    line("h1", 4, inside=article)
    for _ in range(r.randint(0, 8)):
        line("p", r.choice([1, 3, 20, 80]), inside=article, end=r.random() < 0.5)
        if r.random() < 0.3:
            line("div", 5, weigh=False, attributes=" class='ad'")
    if article:
        known.extend([("", 0, False)] * html_text.WINDOW)
        out.append("</article>")
    rest()
    return "".join(out), known


@pytest.mark.parametrize("seed", range(4))
def test_random_pages(seed):
    r = random.Random(seed)
    for k in range(60):
        page, known = random_page(r, k % 2 == 0)
        own = [w * inside for _, w, inside in known]
        used = own if any(own) else [w for _, w, _ in known]
        densest = max(sum(used[i : i + html_text.WINDOW]) for i in range(len(used)))
        least = min(html_text.SURGE, html_text.SHARE * densest)
        assert least > 0
        weights = [max(w, least + 1) if w else 0 for w in own] if any(own) else used
        assert html_text.main_text(page) == "\n\n".join(known[i][0] for i in plain_choice(weights, least, html_text.WINDOW))


def test_pages_without_their_article_tags():
    """What the distribution alone finds: of the article's characters nearly all, and hardly any others."""
    r = random.Random(7)
    right = found = wanted = 0
    for _ in range(200):
        page, known = random_page(r, True)
        got = set(html_text.main_text(page.replace("<article>", "").replace("</article>", "")).split("\n\n"))
        want = {t for t, w, inside in known if w and inside}
        right, found, wanted = right + sum(map(len, got & want)), found + sum(map(len, got)), wanted + sum(map(len, want))
    assert right >= 0.98 * found and right >= 0.98 * wanted


STORY = "".join(f"<p>Line {i} of a story about the rain on the hill.</p>" for i in range(6))
STORY_TEXT = "\n\n".join(["Rain", *(f"Line {i} of a story about the rain on the hill." for i in range(6))])
ADVERT = "<p>Buy the finest kettles of the whole country today for half of what they cost</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='rail'>{ADVERT * 3}</div><article><h1>Rain</h1><p>It rained.</p></article>", "Rain\n\nIt rained."),
        (f"<div class='x9'><p>{'dense words ' * 100}</p></div><article><h1>Rain</h1>{STORY}</article>", STORY_TEXT),
        (f"<article><h1>Rain</h1>{STORY}<div class='kommentare'><p>Nice</p></div></article>", STORY_TEXT),
        (f"<article><h1>Rain</h1>{STORY}<div class='teaser'><a href=/x>Other</a><p>What came next</p></div></article>", STORY_TEXT),
        (f"<article><h1>Rain</h1><p class='teaser'>A lead.</p>{STORY}</article>", STORY_TEXT.replace("Rain", "Rain\n\nA lead.", 1)),
        # Boxes without any article element.
        (f"<h1>Rain</h1>{STORY}<div class='q1'>Win a kettle now</div><p>End.</p>", STORY_TEXT + "\n\nEnd."),
        (f"<div class=a><h1>Rain</h1></div><div class=b>{STORY}</div><div class=c><h3>Win</h3><p>a kettle</p></div>", STORY_TEXT),
        (f"<div id=all><h1>Rain</h1><div class=t>{STORY}</div></div>", STORY_TEXT),
        (f"<h1>Rain</h1><div class=n><p><a href=/1>One of the other stories</a> 3 <a href=/2>and one more of these stories, a long one</a></p>{ADVERT[:3]}</div>{STORY}", STORY_TEXT),
        ("<section><p>only</p></section>", "only"),
    ],
)
def test_boxes(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("seed", range(3))
def test_names_say_nothing(seed, monkeypatch):
    """Without any list of names, and classes drawn at random, short boxes around a dense one are left out."""
    monkeypatch.setattr(html_text, "MARKS", frozenset())
    monkeypatch.setattr(html_text, "WEAK", frozenset())
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    for k in range(100):
        other = lambda: "".join(f"<div class='{word()}{i}'>{words(r.randint(1, 6))}</div>" for i in range(r.randint(0, 3)))  # noqa: B023, E731
        text = [words(5), *(words(r.choice([1, 12, 40, 80])) for _ in range(r.randint(1, 6))), words(40)]
        inner = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
        page = other() + (inner, f"<article>{inner}</article>", f"<div class='{word()}'>{inner}</div>")[k % 3] + other()
        assert html_text.main_text(page) == "\n\n".join(text)


def test_extract(spark):
    rows = [(i, f"http://h/{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(3, None, PAGES[3][0], "x"), (None, "u", PAGES[4][0], "x")]
    pages_ = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(pages_).collect(), key=str)
    texts = dict(PAGES)
    want = [(i, u, texts[p], len(texts[p])) for i, u, p, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert html_text.extract(pages_.limit(0)).collect() == []


@pytest.mark.parametrize("page", ['<a "' * 20000, "<" * 50000, "<p>" * 30000, "<!--" * 20000, "<script" * 20000, "<div class=x " * 20000, "<a>x" * 30000, "<div><b>" * 20000 + "</b>" * 20000, "<div><li>" * 20000, "<textarea>" * 20000, "<section><table><td>" + "<div></section>" * 20000, "<form>" * 20000 + "<h1>x" * 20000, "<b>x<p>" * 20000])
def test_broken_markup_ends_soon(page):
    html_text.main_text(page)


def test_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * n for n in (0, 5, 50, 3, 3, 0)] + [None, "b"])})
    got = pieces(batch, 0, 10)
    assert [p.num_rows for p in got] == [2, 1, 5]
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    assert pieces(batch.slice(0, 0), 0, 10) == []


def test_short_items_and_scripts_without_spaces():
    items = [(1, "Forty two"), (2, "forty two"), (3, "一二三四五六七八九十"), (4, "ภาษาไทยง่าย"), (5, "..."), (6, "one two three four five six"), (7, "漢字")]
    index = decontaminate.Index(items)
    texts = ["It is FORTY, two!", "forty and two", "前文一二三四五六x八九十後文", "เขียนภาษาไทยง่ายมาก", "", "one two three four nine six", "これは漢字です", "漢の字"]
    assert {(d, i, e) for d, i, e in index.search(texts)} == {(0, 1, 0), (0, 2, 0), (2, 3, 1), (3, 4, 0), (5, 6, 1), (6, 7, 0)}
    assert decontaminate.Index(items[:2]).search(["say forty two"]) == [(0, 1, 0), (0, 2, 0)]
    assert decontaminate.words("aé 日本x") == ["aé".encode(), "日".encode(), "本".encode(), b"x"]

"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by a benchmark item when some stretch of its words
is within ``1 - SIMILARITY`` of the item's words in edit distance (words in
lower case, punctuation left out; in scripts without spaces each character is a
word). Windows as long as the item are embedded by
the Chakraborty-Goldenberg-Koucky random walk: at each of 3n steps the walk
writes the word at hand and stays or moves on by a random bit of (step, word), so
that few edits become few differing places. A key samples ``SAMPLES`` places of
a walk; windows and items that share a key are candidates. For each length
of items walks are repeated until, over edited copies of the items of that length at the greatest distance
allowed, at least ``RECALL`` meet their item, with fewer places to a key if that takes more than ``WALKS``
walks; should nothing reach it, all items of that length that share enough word pairs with a text are
candidates. The recall measured is kept with the index, by length. Candidates are verified by the
exact edit distance (Myers' bit vectors over words) around the window.

Windows that cannot match are not embedded: each edit destroys two word pairs
of an item at most, so a match of n words has n - 1 - 2 * edits of the item's pairs,
and a window with fewer pairs of the items of its length is passed over without loss.

Items with equal text are one in the search, and each matches. Items come in blocks of ``BLOCK``, a
bounded share of the table each; one scan of the documents meets the ``TOGETHER`` blocks that go to the executors
at a time. Items of fewer than ``MIN_WORDS`` words allow no
edit and match where all their words stand in a row; items without words match nothing. Null and empty texts match
nothing. Texts of any length are searched whole, in time in proportion. Repeated documents match each on its own. Extra columns pass through untouched
(``drop_contaminated``) or are not read (``matches``), whatever their names. Either table may be empty.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, pieces, strings

SIMILARITY, RECALL, MIN_WORDS = 0.8, 0.95, 5
SAMPLES, KEYS, WALKS, COPIES, SEED = 4, 8, 8, 400, 5
BLOCK, TOGETHER = 5000, 8
PIECE_BYTES = 4 << 20
#: Windows that are embedded together, and steps of their walks, at most.
_WINDOWS, _STEPS = 8192, 1 << 21
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: A character of Thai, Lao, Burmese, Khmer, kana or Chinese in UTF-8.
_UNSPACED = re.compile(
    rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80\x81\x9e\x9f][\x80-\xbf]|\x82[\x80-\x9f])"
    rb"|\xe3(?:\x80[\x85-\x87]|[\x81-\x83\x90-\xbf][\x80-\xbf]|\x87[\xb0-\xbf])|\xe4(?:[\x80-\xb6]|[\xb8-\xbf])[\x80-\xbf]|[\xe5-\xe9][\x80-\xbf]{2}"
    rb"|\xef(?:[\xa4-\xab][\x80-\xbf]|\xbd[\xa6-\xbf]|\xbe[\x80-\x9f])|\xf0[\xa0-\xbf][\x80-\xbf]{2}"
)


def words(text: str) -> list[bytes]:
    data = text.lower().encode("utf-8", "surrogatepass")
    return _WORD.findall(data if data.isascii() else _UNSPACED.sub(rb" \g<0> ", data))


def closest(item: list[int], text: list[int]) -> int:
    """The least edit distance between ``item`` and any stretch of ``text`` (Myers 1999)."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item):
        masks[w] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(xh | up) & full, up & xh
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(xv | rise) & full, rise & xv
        best = min(best, score)
    return best


class Walks:
    """Random walks and key samples for items of n words over a vocabulary."""

    def __init__(self, n: int, size: int, n_walks: int, samples: int, seed: int):
        rng = np.random.default_rng([seed, n])
        self.n, self.steps, self.n_walks = n, 3 * n, n_walks
        # The bit of a step and a word is the parity of what their two random numbers share.
        self.of_word = rng.integers(0, 1 << 62, size, np.int64)
        self.of_word[-1] = 0  # past the end the walk stays
        self.of_step = rng.integers(0, 1 << 62, (n_walks, self.steps), np.int64)
        self.places = rng.integers(0, self.steps, (n_walks, KEYS, samples))
        self.mix = rng.integers(1, 1 << 62, (n_walks, KEYS, samples), np.int64).view(np.uint64) | np.uint64(1)

    def keys(self, windows: np.ndarray, walk: int) -> np.ndarray:
        """(rows, KEYS) keys of windows of n words, by one walk."""
        x = np.concatenate([windows, np.full((len(windows), 1), len(self.of_word) - 1, windows.dtype)], axis=1)
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        out = np.empty((self.steps, len(x)), np.int32)
        for j, step in enumerate(self.of_step[walk]):
            w = x[rows, at]
            out[j] = w
            at += np.bitwise_count(self.of_word[w] & step) & 1
            np.minimum(at, self.n, out=at)
        sampled = out[self.places[walk]].astype(np.uint64) + np.uint64(1)  # (KEYS, samples, rows)
        mixed = sampled * self.mix[walk][:, :, None]
        return (mixed ^ mixed >> np.uint64(29)).sum(axis=1, dtype=np.uint64).T


class Index:
    """All that an executor needs to search texts for a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = SEED):
        of: dict[tuple[bytes, ...], list[int]] = defaultdict(list)  # ids by words
        for i, t in items:
            if w := tuple(words(t or "")):
                of[w].append(i)
        self.short: dict[bytes, list[tuple[tuple[bytes, ...], list[int]]]] = defaultdict(list)  # by first word
        for w, ids in of.items():
            if len(w) < MIN_WORDS:
                self.short[w[0]].append((w, ids))
        tokens = [(ids, w) for w, ids in of.items() if len(w) >= MIN_WORDS]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, w in tokens for x in w}))}
        self.size = len(self.vocabulary) + 2  # 0: any other word; the last: past the end
        self.items = [(ids, np.array([self.vocabulary[x] for x in w], np.int32)) for ids, w in tokens]
        self.share = 1 - similarity
        self.own_pairs = [np.unique(w[:-1].astype(np.int64) * self.size + w[1:]) for _, w in self.items]
        self.pairs = np.unique(np.concatenate(self.own_pairs)) if self.items else np.zeros(0, np.int64)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            self.by_length[len(w)].append(k)
        self.pairs_of_length, self.walks, self.tables, self.recall = {}, {}, {}, {}
        for n, members in self.by_length.items():
            # A bit for each pair.
            self.pairs_of_length[n] = np.packbits(np.isin(self.pairs, np.concatenate([self.own_pairs[k] for k in members])))
            own = np.stack([self.items[k][1] for k in members])
            self.walks[n], self.recall[n] = self._choose(n, own, recall, seed)
            for walk in range(self.walks[n].n_walks if self.walks[n] else 0):
                keys = self.walks[n].keys(own, walk)
                order = np.argsort(keys, axis=0, kind="stable")
                self.tables[n, walk] = (np.take_along_axis(keys, order, 0), np.array(members)[order])

    def edits(self, n: int) -> int:
        return int(self.share * n + 1e-9)

    def least_pairs(self, n: int) -> int:
        """Pairs of an item of n words that a match holds at least."""
        return max(1, n - 1 - 2 * self.edits(n))

    def _choose(self, n: int, own: np.ndarray, recall: float, seed: int) -> tuple[Walks | None, float]:
        """Walks by which edited copies of the items of n words meet them with at least ``recall``, as measured, and that share; None where nothing reaches it."""
        rng = np.random.default_rng([seed, n])
        of = rng.permutation(np.arange(COPIES) % len(own))
        copies = np.zeros((COPIES, n), np.int32)
        for r, k in enumerate(of.tolist()):
            copy = own[k].tolist()
            for _ in range(self.edits(n)):
                at, kind = int(rng.integers(0, len(copy))), rng.integers(0, 3)
                copy[at : at + int(kind != 1)] = [0] * int(kind != 2)
            copies[r, : min(n, len(copy))] = copy[:n]
        for samples in range(SAMPLES, 0, -1):
            walks, met = Walks(n, self.size, WALKS, samples, seed), np.zeros(COPIES, bool)
            for w in range(WALKS):
                met |= (walks.keys(copies, w) == walks.keys(own, w)[of]).any(axis=1)
                if met.mean() >= recall:
                    walks.n_walks = w + 1
                    return walks, float(met.mean())
        return None, 1.0

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item id, edit distance) of all matches."""
        return self.search_words([words(t) for t in texts])

    def search_words(self, split: list[list[bytes]]) -> list[tuple[int, int, int]]:
        """The same for texts split into words."""
        return sorted((doc, item_id, edits) for doc, ids, edits in self._near(split) + self._exact(split) for item_id in ids)

    def _exact(self, split: list[list[bytes]]) -> list[tuple[int, list[int], int]]:
        """Matches of the items below ``MIN_WORDS`` words."""
        if not self.short:
            return []
        out = []
        for doc, w in enumerate(split):
            met = {}
            for at in [k for k, x in enumerate(w) if x in self.short]:
                for item, ids in self.short[w[at]]:
                    if tuple(w[at : at + len(item)]) == item:
                        met[item] = (doc, ids, 0)
            out += met.values()
        return out

    def _near(self, split: list[list[bytes]]) -> list[tuple[int, list[int], int]]:
        if not self.items or not split:
            return []
        get = self.vocabulary.get
        coded = [[get(w, 0) for w in ws] for ws in split]
        lengths = np.array([len(c) for c in coded])
        ids = np.fromiter((x for c in coded for x in c), np.int32, int(lengths.sum()))
        if len(ids) < MIN_WORDS - 1:
            return []
        ends = np.cumsum(lengths)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        both = both[~np.isin(both, ends - 1)]
        pair = ids[both].astype(np.int64) * self.size + ids[both + 1]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[place] == pair
        both, place = both[hit], place[hit]
        known = np.concatenate([[0], np.cumsum(ids > 0, dtype=np.int32)])
        begins = ends - lengths
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        out: list = []
        for n, own in self.pairs_of_length.items():
            mine = (own[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)
            at, need, reach = both[mine], self.least_pairs(n), n + self.edits(n)
            if len(at) < need:
                continue
            if self.walks[n] is None:
                out += self._exhaustive(n, place[mine], np.searchsorted(ends, at, "right"), ids, begins, ends)
                continue
            # A window of ``reach`` words that starts from low to high holds these pairs, the first of them at high.
            high, low = at[: len(at) - need + 1], at[need - 1 :] - reach + 2
            low = np.maximum(low, begins[np.searchsorted(ends, high, "right")])
            ok = low <= high
            span = (high - low + 1)[ok]
            starts = np.unique(np.arange(span.sum()) + np.repeat(low[ok] - (np.cumsum(span) - span), span))
            starts = starts[known[np.minimum(starts + reach, len(ids))] - known[starts] >= n - self.edits(n)]
            step = min(_WINDOWS, max(1, _STEPS // (3 * n)))
            for low in range(0, len(starts), step):
                self._candidates(n, starts[low : low + step], ids, ends, found)
        for (doc, k), starts in sorted(found.items()):
            item_ids, item = self.items[k]
            item = item.tolist()
            n, most = len(item), self.edits(len(item))
            first, end = int(ends[doc] - lengths[doc]), int(ends[doc])
            best, covered = n, -1
            for s in sorted(set(starts)):
                if s + n + most <= covered:
                    continue
                # Windows that overlap are verified as one stretch.
                covered = min(end, s + 2 * (n + most))
                stretch = ids[max(first, s - n - most) : covered]
                if self._shared(k, stretch) >= self.least_pairs(n):
                    best = min(best, closest(item, stretch.tolist()))
            if best <= most:
                out.append((doc, item_ids, best))
        return out

    def _shared(self, k: int, stretch: np.ndarray) -> int:
        """How many of the word pairs of a stretch are pairs of item k."""
        pairs, own = stretch[:-1].astype(np.int64) * self.size + stretch[1:], self.own_pairs[k]
        return int((own[np.minimum(np.searchsorted(own, pairs), len(own) - 1)] == pairs).sum())

    def _exhaustive(self, n, place, doc, ids, begins, ends) -> list[tuple[int, list[int], int]]:
        """Matches of all items of n words with all texts that hold enough of their pairs. place: which pair, doc: in which text."""
        out = []
        for k in self.by_length[n]:
            held = np.bincount(doc[np.isin(place, np.searchsorted(self.pairs, self.own_pairs[k]))], minlength=len(ends))
            for d in np.flatnonzero(held >= self.least_pairs(n)).tolist():
                best = closest(self.items[k][1].tolist(), ids[begins[d] : ends[d]].tolist())
                if best <= self.edits(n):
                    out.append((d, self.items[k][0], best))
        return out

    def _candidates(self, n, starts, ids, ends, found) -> None:
        doc = np.searchsorted(ends, starts, "right")
        places = starts[:, None] + np.arange(n)
        windows = np.where(places < ends[doc][:, None], ids[np.minimum(places, len(ids) - 1)], 0)
        met = []
        for walk in range(self.walks[n].n_walks):
            keys = self.walks[n].keys(windows, walk)
            table, members = self.tables[n, walk]
            for m in range(KEYS):
                low = np.searchsorted(table[:, m], keys[:, m])
                many = np.searchsorted(table[:, m], keys[:, m], "right") - low
                rows = np.repeat(np.arange(len(starts)), many)
                each = np.arange(len(rows)) + np.repeat(low - (np.cumsum(many) - many), many)
                met.append(rows * len(self.items) + members[each, m])
        for code in np.unique(np.concatenate(met)).tolist():
            r, k = divmod(code, len(self.items))
            found[int(doc[r]), k].append(int(starts[r]))


def indexes(items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, together: int = TOGETHER) -> Iterator[Broadcast]:
    """Lists of ``together`` indexes, each of about ``block`` items (item_id, text), on the executors. One list is all that the driver holds at a time."""
    sc, n = items.sparkSession.sparkContext, max(1, -(-items.count() // block))
    for first in range(0, n, together):
        held = []
        for k in range(first, min(n, first + together)):
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
            held.append(Index(sorted(((r.item_id, r.text or "") for r in rows), key=lambda r: (r[0] is None, r)), similarity, recall))
        yield sc.broadcast(held)


def distinct_items(items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Items (item_id, text) of which no two have the same text, and which ids (item_id) stand behind each of them (own); None where that is its own id."""
    items = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    single = items.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    if single.where("n > 1").isEmpty():
        return items, None
    # Numbers that stay, as they are kept.
    single = cut(single.select("text", F.monotonically_increasing_id().alias("own")))
    return single.select(F.col("own").alias("item_id"), "text"), items.join(single, "text").select("own", "item_id")


def matches(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, edits) of every document and item that match."""
    items, behind = distinct_items(items)
    found = None
    for shared in indexes(items, **options):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, 1, PIECE_BYTES):
                    ids, split = batch.column(0).to_pylist(), [words(t) for t in strings(batch.column(1))]
                    hits = [hit for index in shared.value for hit in index.search_words(split)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64())], names=["doc_id", "item_id", "edits"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, edits long")
        found = part if found is None else found.unionByName(part)
    if behind is not None:
        found = found.withColumnRenamed("item_id", "own").join(behind, "own").select("doc_id", "item_id", "edits")
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no item matches, with all their columns."""
    at = docs.columns.index("text")
    for shared in indexes(distinct_items(items)[0], **options):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, at, PIECE_BYTES):
                    clean, split = np.ones(batch.num_rows, bool), [words(t) for t in strings(batch.column(at))]
                    for index in shared.value:
                        clean[[h[0] for h in index.search_words(split)]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

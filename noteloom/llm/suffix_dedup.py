"""Removal of repeated passages by suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one. Texts are UTF-8.

1. Anchors. Every window of ``LENGTH`` bytes has an anchor, the ``GRAM`` bytes with the
   least hash within it, so equal windows have equal anchors (winnowing). Anchors
   are counted; only text around anchors that occur twice can repeat.
2. Shards. A document goes to the shard of its least anchor, so that most copies
   meet in one shard; shards hold about ``SHARD_BYTES``. Least anchors that more than ``SALT_ROWS``
   documents have deal these out over several shards. They are counted in ``1 << CELL_BITS`` cells, so that what
   tasks have to know of them is bounded whatever the corpus; anchors that share a cell are dealt out more than they need.
3. Suffix array. Each shard sorts the suffixes of its text around repeated
   anchors by their first ``LENGTH`` bytes, by Larsson and Sadakane's refinement:
   groups that agree in h bytes are split by the rank of what follows after h,
   h doubling, groups of one left alone. Kasai's algorithm, run over many stretches of
   text at once, gives the common prefixes; neighbours that share ``LENGTH``
   bytes are equal windows. All but the first are repeats.
4. Merging. First windows whose anchor also occurs in other shards go, as runs
   of text, to the task of their anchor. There the windows of all shards make one
   sorted list, each shard's windows are looked up in it by binary search, and
   the earliest of equal windows stays. Runs of anchors with more than ``HOT``
   occurrences are dealt by their text instead, so that a common line does not
   bring all that surrounds it to one task, and equal ones among the shards of a task become one before they
   leave it, so that a passage of very many shards comes from each task once.
5. Repeats are united per document and cut out.

Null and empty texts, and texts under ``LENGTH`` bytes, lose nothing. A document stays in one shard, however long; an
empty table gives no rows, and columns other than ``doc_id`` and ``text`` are not read, whatever their names. Of rows that share an id the
one that is read first counts as earlier; rows without an id count as last. Rows are numbered
as they are read, three times, so ``docs`` has to come from files or another stable source.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import buffer, cut, pieces, release

LENGTH, GRAM = 100, 24
SHARD_BYTES, PIECE_BYTES, BLOCK, PACK = 1 << 20, 4 << 20, 1 << 15, 21
HOT, SALT_ROWS, CELL_BITS = 1000, 128, 24
#: Bytes of runs that are merged together; every byte of them takes some hundred of memory.
MERGED = 1 << 20
#: Bytes of runs of hot anchors that a task looks through for equal ones before it passes them on.
PREMERGED = 8 << 20
#: Consecutive windows of a hot anchor that are dealt together.
DEAL = 8
_U = np.uint64
_P = [_U(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_BYTES = _U(1) << np.arange(0, 64, 8).astype(_U)
_LAST = np.int64(2**63 - 1)


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, first byte highest; zero bytes follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16 - n % 8, np.uint8)])
    out = np.empty(n + 8 - n % 8, _U)
    for k in range(8):
        part = padded[k : k + len(out)].view(">u8") if len(out) else padded[:0].view(">u8")
        out[k::8] = part
    return out[:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position that has so many."""
    w = words(data)
    n = len(data) - GRAM + 1
    h = w[:n] * _P[0]
    h ^= h >> _U(32)
    h += w[8 : 8 + n]
    h *= _P[1]
    h ^= h >> _U(29)
    h += w[16 : 16 + n]
    h *= _P[3]
    h ^= h >> _U(32)
    h *= _P[2]
    return h


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = take(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = take(out[: len(out) - (width - have)], out[width - have :])
    return out


class Anchors:
    """Anchors of texts that lie one after the other in ``data``: position, hash, and order (high bits of the hash).

    ``least`` is the order of the anchor of the window that starts at a position, zero where no window fits into its text.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n, width = len(data), LENGTH - GRAM + 1
        whole = np.ones(n, bool)
        starts, ends = at[:-1], at[1:]
        for k in range(1, LENGTH):
            fits = ends - k >= starts
            starts, ends = starts[fits], ends[fits]
            whole[ends - k] = False
        self.least = np.zeros(n, np.uint32)
        found = []
        # Blocks that stay within a processor's cache.
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            low, high = max(0, a - width + 1), min(n - GRAM + 1, b + width - 1)
            if high - low < width:
                continue
            h = gram_hashes(data[low : high + GRAM - 1])
            order = (h >> _U(32)).astype(np.uint32)
            np.maximum(order, 1, out=order)
            least = np.zeros(b - a + width - 1, np.uint32)  # of windows from a - width + 1 on
            skip = low - (a - width + 1)
            mine = _slide(order, width, np.minimum)[: b - low]
            mine *= whole[low : low + len(mine)]
            least[skip : skip + len(mine)] = mine
            self.least[a:b] = least[width - 1 :]
            chosen = _slide(least, width, np.maximum)
            got = order[a - low : b - low]
            position = np.flatnonzero(got == chosen[: len(got)])
            found.append((position + a, h[a - low :][position], got[position]))
        self.position, self.hash, self.order = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.uint32))


def doc_keys(a: Anchors, at: np.ndarray) -> np.ndarray:
    """The hash of each text's least anchor, zero for a text without any."""
    out = np.zeros(len(at) - 1, _U)
    first = np.searchsorted(a.position, at)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.minimum.reduceat(a.hash, first[:-1][some])
    return out


def suffix_order(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions sorted by the ``LENGTH`` bytes from them on (Larsson and Sadakane), and where a group of equal ones begins. Zero bytes follow the end."""
    n = len(w)
    sa = np.argsort(w).astype(np.int32)
    rank = np.full(n + LENGTH, -1, np.int32)
    low = _U((1 << PACK) - 1)
    key = w[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    h = 8
    while True:
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        # Groups of one keep their place.
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if h >= LENGTH or not len(slots):
            return sa, new
        rank[sa] = np.repeat(head.astype(np.int32), size)
        step = min(h, LENGTH - h)
        mine = sa[slots]
        # Rank, rank of what follows, and position fit into one number for up to 2 ** PACK bytes, which a plain sort takes.
        if n < 1 << PACK:
            key = (rank[mine].astype(_U) << _U(2 * PACK)) | ((rank[mine + step] + 1).astype(_U) << _U(PACK)) | mine.astype(_U)
            key.sort()
            sa[slots] = (key & low).astype(np.int32)
            key >>= _U(PACK)
        else:
            key = rank[mine].astype(np.int64) << 32 | rank[mine + step] + 1
            by = np.argsort(key)
            sa[slots] = mine[by]
            key = key[by]
        new[slots[1:]] |= key[1:] != key[:-1]
        h += step


def common_prefixes(w: np.ndarray, sa: np.ndarray, new: np.ndarray, stretch: int = 256) -> np.ndarray:
    """Kasai's common prefixes of neighbours in ``sa``, up to ``LENGTH``, for all stretches of text in step.

    In text order a position shares at most one byte less with its neighbour
    than the position before it did, unless that one was equal to its own
    neighbour in all ``LENGTH`` bytes, where the order says nothing of what follows.
    """
    n = len(sa)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    equal = np.zeros(n, bool)
    equal[sa] = ~new
    wide = np.concatenate([w, np.zeros(LENGTH, _U)])
    plcp = np.zeros(n, np.uint8)
    base = np.arange(0, n, stretch)
    shared, afresh = np.zeros(len(base), np.int64), np.ones(len(base), bool)
    for k in range(stretch):
        if base[-1] + k >= n:
            base, shared, afresh = base[:-1], shared[:-1], afresh[:-1]
            if not len(base):
                break
        p = base + k
        q, same = before[p], equal[p]
        shared = np.maximum(shared - 1, 0) * ~afresh
        shared[same] = LENGTH
        go = np.flatnonzero(~same & (q >= 0))
        while len(go):  # eight bytes at a time
            have = shared[go]
            agree = 8 - np.searchsorted(_BYTES, wide[p[go] + have] ^ wide[q[go] + have], "right")
            have += agree
            shared[go] = np.minimum(have, LENGTH)
            go = go[(agree == 8) & (have < LENGTH)]
        shared[q < 0] = 0
        plcp[p] = shared
        afresh = same | (q < 0)
    return plcp[sa]


def repeats_within(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Of the positions marked valid, those at which a window starts that also starts at an earlier valid one."""
    out = np.zeros(len(data), bool)
    if not valid.any():
        return out
    w = words(data)
    sa, new = suffix_order(w)
    lcp = common_prefixes(w, sa, new)
    fine = valid[sa]
    # Among valid neighbours the common prefix is the least in between.
    group = np.cumsum(lcp < LENGTH)[fine]
    places = sa[fine]
    if not len(places):
        return out
    head = np.flatnonzero(np.diff(group, prepend=-1))
    first = np.repeat(np.minimum.reduceat(places, head), np.diff(np.append(head, len(places))))
    out[places[places != first]] = True
    return out


def window_hashes(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(starts), _U)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        h ^= w[starts + k]
        h *= _P[k % 3]
        h ^= h >> _U(31)
    return h


_RUNS = "key long, hot boolean, home long, uid long, doc_id long, start long, text binary"


def joined(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, in order, with those that touch made one."""
    if not len(low):
        return low, high, doc
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)
    return low[new], high[last], doc[new]


def shard_repeats(texts: pa.Table, repeated: pa.Table) -> pa.Table:
    """Step 3 and the first half of step 4 for one shard: rows of repeats (text null, key their end) and of runs of windows to be merged."""
    rows: dict[str, list] = {k: [] for k in ("key", "hot", "home", "uid", "doc_id", "start", "text")}

    def add(doc, key, hot, start, text) -> None:
        for k, v in zip(rows, (key, hot, home[doc], uid[doc], doc_id[doc], start, text)):
            rows[k].append(v)

    if texts.num_rows and repeated.num_rows:
        order = np.lexsort((texts["uid"].to_numpy(), texts["doc_id"].fill_null(_LAST).to_numpy()))
        texts = texts.take(order).combine_chunks()
        home, uid, doc_id = texts["shard"].to_numpy(), texts["uid"].to_numpy(), texts["doc_id"].fill_null(_LAST).to_numpy()
        data, at = buffer(texts["text"].chunk(0))
        a = Anchors(data, at)
        h, count = repeated["h"].to_numpy(), repeated["n"].to_numpy()
        by = np.argsort(h)
        h, count = h[by], count[by]
        place = np.minimum(np.searchsorted(h, a.hash.view(np.int64)), len(h) - 1)
        twice = h[place] == a.hash.view(np.int64)
        position, turn, place = a.position[twice], a.order[twice], place[twice]
        doc = np.searchsorted(at, position, "right") - 1
        # Text around repeated anchors, in stretches within a text; windows start where they fit into their stretch.
        low, high, _ = joined(np.maximum(position + GRAM - LENGTH, at[doc]), np.minimum(position + LENGTH, at[doc + 1]), doc)
        low, high = low[high - low >= LENGTH], high[high - low >= LENGTH]
        size = high - low
        base = np.cumsum(size) - size
        small = np.concatenate([data[x:y] for x, y in zip(low.tolist(), high.tolist())]) if len(low) else data[:0]
        valid = np.ones(len(small), bool)
        for k in range(1, LENGTH):
            valid[base + size - k] = False
        again = repeats_within(small, valid)

        def whole(mark: np.ndarray) -> np.ndarray:
            """Positions in all text of those marked in the stretches."""
            i = np.flatnonzero(mark)
            return i + (low - base)[np.searchsorted(base, i, "right") - 1]

        # Repeats: the bytes that their windows cover.
        p = whole(again)
        lo, hi, d = joined(p, p + LENGTH, np.searchsorted(at, p, "right") - 1)
        add(d, hi - at[d], np.zeros(len(d), bool), lo - at[d], [None] * len(lo))
        # First windows whose anchor occurs elsewhere too.
        elsewhere = (count > np.bincount(place, minlength=len(h)))[place]
        p = whole(valid & ~again)
        k, open_ = np.searchsorted(position, p), np.arange(len(p))
        found = np.full(len(p), -1)
        while len(open_):
            fits = k < len(position)
            open_, k = open_[fits], k[fits]
            fits = position[k] <= p[open_] + LENGTH - GRAM
            open_, k = open_[fits], k[fits]
            hit = turn[k] == a.least[p[open_]]
            found[open_[hit]] = k[hit]
            open_, k = open_[~hit], k[~hit] + 1
        p, found = p[found >= 0], found[found >= 0]
        p, found = p[elsewhere[found]], found[elsewhere[found]]
        if len(p):
            hot = count[place[found]] > HOT
            deal = np.where(hot, (position[found] - p) // DEAL, -1)
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1] + 1) | (found[1:] != found[:-1]) | (deal[1:] != deal[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)
            lo, hi, found, deal = p[new], p[last] + LENGTH, found[new], deal[new]
            key = h[place[found]].copy()
            # A hot anchor's windows are dealt by the text that all windows of their group share.
            for j in np.flatnonzero(deal >= 0):
                shared = position[found[j]] - DEAL * deal[j]
                key[j] = int.from_bytes(hashlib.blake2b(data[shared : shared + LENGTH - DEAL + 1].tobytes(), digest_size=8, key=int(deal[j]).to_bytes(2, "big")).digest(), "big", signed=True)
            d = np.searchsorted(at, lo, "right") - 1
            add(d, key, deal >= 0, lo - at[d], [data[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())])
    release()
    cols = {k: np.concatenate(rows[k]).astype(np.int64) if rows[k] else np.zeros(0, np.int64) for k in rows if k != "text"}
    return pa.Table.from_arrays([*(pa.array(v.astype(bool) if k == "hot" else v) for k, v in cols.items()), pa.array([t for part in rows["text"] for t in part], pa.binary())], names=list(rows))


def merge_runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, again) of all windows of some runs: again where an equal window starts earlier in another run."""
    data, at = buffer(rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0))
    home, uid, doc_id, start = (rows[c].to_numpy() for c in ("home", "uid", "doc_id", "start"))
    n = np.diff(at) - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = at[:-1][row] + offset
    w = words(data)
    hashes = window_hashes(w, place)
    # Earliest first, so that the first of equal windows is the one that stays.
    order = np.lexsort((start, uid, doc_id))
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    age = turn[row] << 20 | np.minimum(offset, (1 << 20) - 1)
    # One sorted list of all shards' windows, in which each shard's are looked up.
    merged = np.unique(hashes)
    slot = np.empty(len(hashes), np.int64)
    by = np.argsort(home[row], kind="stable")
    edges = np.append(np.flatnonzero(np.diff(home[row][by], prepend=-1)), len(by))
    for a, b in zip(edges, edges[1:]):
        slot[by[a:b]] = np.searchsorted(merged, hashes[by[a:b]])
    oldest = np.full(len(merged), np.iinfo(np.int64).max)
    np.minimum.at(oldest, slot, age)
    is_oldest = oldest[slot] == age
    first = np.empty(len(merged), np.int64)
    first[slot[is_oldest]] = place[is_oldest]
    later = np.flatnonzero(~is_oldest)
    same = np.ones(len(later), bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same &= w[place[later] + k] == w[first[slot[later]] + k]
    again = np.zeros(len(row), bool)
    again[later[same]] = True
    return row, offset, again


def stretches(rows: pa.Table, row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of runs, those that start one after the other made one: (row, first, last offset)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)[: new.sum()]
    return row[new], offset[new], offset[last]


def premerged(rows: pa.Table) -> pa.Table:
    """Runs of hot anchors; of those with equal text the first one, and rows of repeats for the others."""
    code = rows["text"].chunk(0).dictionary_encode().indices.to_numpy()
    if len(code) == 0 or np.bincount(code).max() == 1:
        return rows
    order = np.lexsort((rows["start"].to_numpy(), rows["uid"].to_numpy(), rows["doc_id"].to_numpy(), code))
    again = order[1:][code[order[1:]] == code[order[:-1]]]
    stays = np.ones(len(code), bool)
    stays[again] = False
    repeats = rows.take(pa.array(again))
    end = pa.compute.add(repeats["start"], pa.compute.binary_length(repeats["text"]).cast(pa.int64()))
    repeats = repeats.set_column(0, "key", end).set_column(1, "hot", pa.array(np.zeros(len(again), bool))).set_column(6, "text", pa.nulls(len(again), pa.binary()))
    return pa.concat_tables([repeats.cast(rows.schema), rows.filter(pa.array(stays))])


def merge_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, equal runs of hot anchors among them made one, some bytes at a time."""
    held, size = [], 0
    for batch in batches:
        hot = batch.column("hot")
        yield batch.filter(pa.compute.invert(hot))
        runs = batch.filter(hot)
        held.append(runs)
        size += runs.column("text").nbytes
        if size > PREMERGED:
            yield from premerged(pa.Table.from_batches(held).combine_chunks()).to_batches()
            held, size = [], 0
    if size:
        yield from premerged(pa.Table.from_batches(held).combine_chunks()).to_batches()


def cut_out(texts: pa.Table, repeats: pa.Table) -> pa.Table:
    """Step 5 for one shard: what is left of each text."""
    uid, low, high = (repeats[c].to_numpy() for c in ("uid", "low", "high"))
    by = np.lexsort((low, uid))
    uid, low, high = uid[by], low[by], high[by]
    out = []
    for doc_id, own, text in zip(texts["doc_id"].to_pylist(), texts["uid"].to_pylist(), texts["text"].to_pylist()):
        text = text or b""
        a, b = np.searchsorted(uid, own), np.searchsorted(uid, own, "right")
        spans, removed, at, kept = 0, 0, 0, []
        end = -1
        for x, y in zip(low[a:b].tolist(), high[a:b].tolist()):
            if x > end:
                spans += 1
            if y > max(end, at):
                kept.append(text[at:x] if x > at else b"")
                removed += y - max(x, at)
                at = y
            end = max(end, y)
        kept.append(text[at:])
        out.append((doc_id, len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
    cols = list(zip(*out)) or [[]] * 5
    return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of what is left."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_BYTES):
                data, at = buffer(batch.column(2))
                a = Anchors(data, at)
                keys = doc_keys(a, at)
                found = [np.unique(x, return_counts=True) for x in (a.hash.view(np.int64), cell_of(keys[keys != 0]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["h", "n"])

    def cell_of(doc_key: np.ndarray) -> np.ndarray:
        """Cells are counted among the anchors, as the hashes below ``1 << CELL_BITS``. An anchor that has such a hash only counts for more than it is, which costs no result."""
        return (doc_key & _U((1 << CELL_BITS) - 1)).astype(np.int64)

    rows = _texts(docs)
    whole = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_shards = max(1, -(-whole.bytes // shard_bytes))
    counts = cut(rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    # At most a quarter of the cells can hold so many documents, however many there are.
    often = max(SALT_ROWS, -(-4 * whole.n >> CELL_BITS))
    heavy = counts.where((F.col("h") >= 0) & (F.col("h") < 1 << CELL_BITS) & (F.col("n") > often)).toArrow()
    by = np.argsort(heavy["h"].to_numpy())
    salted = docs.sparkSession.sparkContext.broadcast((heavy["h"].to_numpy()[by], -(-heavy["n"].to_numpy()[by] // often)))

    def shard_of(doc_key: np.ndarray, uid: np.ndarray) -> np.ndarray:
        """Shards by least anchor; texts without anchors, and those of salted ones, by their number too."""
        cells, n = salted.value
        salts = np.ones(len(doc_key), _U)
        if len(cells):
            cell = cell_of(doc_key)
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            salts = np.where(cells[at] == cell, n[at], 1).astype(_U)
        salts[doc_key == 0] = n_shards
        mixed = (uid.astype(_U) * _P[0]) >> _U(20)
        return ((doc_key ^ (mixed % salts + _U(1)) * _P[1]) % _U(n_shards)).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_BYTES):
                data, at = buffer(batch.column(2))
                shard = shard_of(doc_keys(Anchors(data, at), at), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", "doc_id", "uid", "text"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_BYTES):
                data, at = buffer(batch.column(2))
                a = Anchors(data, at)
                shard = shard_of(doc_keys(a, at), batch.column(1).to_numpy())[np.searchsorted(at, a.position, "right") - 1]
                by = np.lexsort((shard, a.hash))
                h, s = a.hash[by], shard[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(s[new])], names=["h", "shard"])

    placed = rows.mapInArrow(place, "shard long, doc_id long, uid long, text binary")
    repeated = rows.mapInArrow(visit, "h long, shard long").join(counts, "h").select("shard", "h", "n")
    found = placed.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(shard_repeats, _RUNS).mapInArrow(merge_hot, _RUNS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeats(rows: pa.Table) -> pa.RecordBatch:
            row, offset, again = merge_runs(rows)
            row, low, high = stretches(rows, row[again], offset[again])
            home, uid, start = (rows[c].to_numpy()[row] for c in ("home", "uid", "start"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (home, uid, start + low, start + high + LENGTH)], names=["shard", "uid", "low", "high"])

        held, size, most = [], 0, MERGED
        for batch in batches:
            known = pa.compute.is_null(batch.column("text"))
            done = batch.filter(known)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column("home"), done.column("uid"), done.column("start"), done.column("key")], names=["shard", "uid", "low", "high"])
            batch = batch.filter(pa.compute.invert(known))
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.column("text").nbytes
            if size > most:
                rows_ = pa.concat_tables(held).combine_chunks()
                keys = rows_["key"].to_numpy()
                last = int(np.flatnonzero(np.diff(keys, prepend=keys[0]))[-1]) if keys[0] != keys[-1] else 0
                if last:  # the last key may go on in the next batch
                    yield repeats(rows_.slice(0, last).combine_chunks())
                    rows_ = rows_.slice(last).combine_chunks()
                held, size = [rows_], rows_["text"].nbytes
                most = max(MERGED, 2 * size)
        if held:
            yield repeats(pa.concat_tables(held).combine_chunks())

    # Rows that are repeats already only pass through, by a key that spreads them.
    keyed = found.withColumn("deal", F.when(F.col("text").isNull(), F.xxhash64("uid", "start")).otherwise(F.col("key")))
    merged = keyed.repartition("deal").sortWithinPartitions("deal").select("key", "home", "uid", "doc_id", "start", "text").mapInArrow(merge, "shard long, uid long, low long, high long")
    return placed.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

"""Language-model scoring by prediction by partial matching (PPM).

A text is read as its words in lower case (A-Z only), joined by one space and
closed by an end mark. A trie of byte contexts up to ``ORDER`` bytes long holds
how often each byte followed each context in the training texts. A byte is
coded in the longest context known; where it never followed that context, an
escape with estimate d / (n + d) (n bytes seen there, d of them distinct) leads
to the next shorter one, in which the bytes of the longer context are excluded.
Below the empty context every byte not yet excluded is equally likely. The
score of a text is the sum of the log10 probabilities of its bytes.

The trie is pretrained: counted over all training texts, partly by each task,
summed by key, and kept whole in a table. As it is not adapted while texts are scored, a byte's
probability follows from the ``ORDER`` bytes before it and the counts alone. Contexts that occur often,
with all their bytes, go to the executors: as many as fit into ``CAPACITY`` entries for each
context length (by a limit on a context's occurrences read from a histogram; all of them where they fit).
Of a context that is there all shorter ones are there, so its bytes are coded at
once. Bytes after other contexts leave as (document, context, byte, times)
and meet the tables by joins, one for each context length. So the executors' share is bounded,
what is learned grows with the corpus, and scores are the same for any ``CAPACITY``.

Word counts are handled alike, under 63-bit hashes: at most ``COMMON`` words go to the
executors, and the others are joined by key.

What the executors get is one file of flat arrays, in the shared checkpoint folder where that is a mounted
one and handed out by ``SparkContext.addFile`` where it is not. Workers map it into memory, so all of a host share it.

Null and empty texts have the end mark alone. Texts are worked through in stretches of ``STEP``
bytes, whatever their length. Repeated rows are scored each on
its own. With no training text, all bytes are equally likely. A null id belongs
to fold 0. An empty table gives no rows. Other columns are not read, whatever their names.
"""
from __future__ import annotations

import mmap
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import BLANKS, bucket_of, buffer, cut, ensure_checkpoint_dir, pieces, release

ORDER = 5
CAPACITY = 1 << 21
COMMON = 1 << 18
FOLD = 1
#: No byte of UTF-8; as the last token it also counts the ends of texts.
END = 255
PIECE_BYTES = 1 << 20
#: Bytes that are coded together; distinct words and grams that a task holds before it passes them on.
STEP, HELD = 1 << 18, 1 << 20
LENGTH = 8 * (ORDER + 1)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[ord(c) for c in BLANKS]] = 32
_PLACES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers for numbers (SplitMix64)."""
    x = x * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


_OF_BYTE = mixed(np.arange(_PLACES << 8, dtype=_U))


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column one after the other, in lower case, with one space between words and the end mark after each text; where texts start."""
    raw, at = buffer(column)
    ends = at[1:] + np.arange(len(at) - 1)
    x = np.empty(len(raw) + len(ends), np.uint8)
    inner = np.ones(len(x), bool)
    inner[ends] = False
    x[inner] = _LOWER[raw]
    x[ends] = END
    blank = x == 32
    word = ~blank
    word[ends] = False
    # Of blanks in a row the last one stays, if a word follows it and one came before.
    stays = ~blank
    stays[:-1] |= word[1:]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin = np.flatnonzero(begin)
    first = begin[np.diff(np.searchsorted(ends, begin), prepend=-1) != 0]
    first = first[first > 0]
    stays[first[blank[first - 1]] - 1] = False
    data = x[stays]
    return data, np.concatenate([[0], np.flatnonzero(data == END)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)


def word_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of texts as ``sequence`` gives them, words and ends of texts (negative numbers; grams have positive ones), and where they start."""
    last = np.flatnonzero((data == 32) | (data == END))
    begin = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    some = last > begin
    ends = last[data[last] == END]
    begin, last = begin[some], last[some]
    # The sum of a number for each byte at its place in the word.
    key = np.zeros(len(begin), _U)
    for a in range(0, len(data), STEP):
        b = min(len(data), a + STEP)
        low, high = np.searchsorted(last, a, "right"), np.searchsorted(begin, b)
        if low >= high:
            continue
        size = np.minimum(last[low:high], b) - np.maximum(begin[low:high], a)
        i = np.flatnonzero((data[a:b] != 32) & (data[a:b] != END))
        place = ((i + a - np.repeat(begin[low:high], size)) << 8) + data[a:b][i]
        far = np.flatnonzero(place >= len(_OF_BYTE))
        of = _OF_BYTE[np.minimum(place, len(_OF_BYTE) - 1)]
        of[far] = mixed(place[far].astype(_U))
        key[low:high] += np.add.reduceat(of, np.cumsum(size) - size)
    key = np.concatenate([key, np.full(len(ends), _OF_BYTE[END])]) | _U(1 << 63)
    return key.view(np.int64), np.concatenate([begin, ends])


def context_lengths(n: int, starts: np.ndarray) -> np.ndarray:
    """How many bytes come before each byte of its text, ``ORDER`` at most."""
    length = np.full(n, ORDER, np.uint8)
    stops = np.append(starts[1:], n)[: len(starts)]
    for k in range(ORDER):
        at = starts + k
        length[at[at < stops]] = k
    return length


def blocks(data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, grams) of stretches of ``STEP`` bytes. A gram is a byte with the ``ORDER`` bytes before it, the byte lowest."""
    for a in range(0, len(data), STEP):
        b = min(len(data), a + STEP)
        n = (b - a + 7) // 8 * 8
        near = np.zeros(n + 8, np.uint8)
        near[max(0, 7 - a) : 7 + b - a] = data[max(0, a - 7) : b]
        out = np.empty(n, _U)
        for k in range(8):
            out[k::8] = near[k : k + n].view(">u8")
        yield a, b, out[: b - a] & _U((1 << LENGTH) - 1)


def tagged(grams: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each gram with as many bytes before its byte as there are, and their number above."""
    length = length.astype(_U)
    return grams & (_U(1) << (length + _U(1) << _U(3))) - _U(1) | length << _U(LENGTH)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    keys, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")  # quick for runs that are sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def count_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all tokens and of all grams, each gram at the longest context that its byte has."""
    data, starts = sequence(column)
    found = [np.unique(word_keys(data)[0], return_counts=True)]
    length = context_lengths(len(data), starts)
    for a, b, grams in blocks(data):
        found.append(np.unique(tagged(grams, length[a:b]).view(np.int64), return_counts=True))
    return merged(found)


def table(keys: np.ndarray, often: np.ndarray, payload: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """An open-addressing hash table of distinct numbers, at most three quarters full: its slots' keys, all ones where empty, and what belongs to them.

    Of numbers that ask for one slot the one that occurs most often has it, so that few lookups take a second step.
    """
    order = np.argsort(often, kind="stable")
    keys = keys[order]
    bits = max(4, (len(keys) * 4 // 3).bit_length())
    slots = np.full(1 << bits, ~_U(0))
    place = np.full(1 << bits, -1, np.int32)
    left, at = np.arange(len(keys)), _slot(keys, len(slots))
    while len(left):
        free = place[at] < 0
        place[at[free]] = left[free]  # the last one wins
        won = place[at] == left
        slots[at[won]] = keys[left[won]]
        left, at = left[~won], (at[~won] + 1) & (len(slots) - 1)
    out = {"keys": slots}
    for name, values in payload.items():
        # Counts in as few bytes as hold them.
        out[name] = np.zeros(len(slots), values.dtype if values.dtype.kind == "f" else np.min_scalar_type(int(values.max(initial=0))))
        out[name][place >= 0] = values[order[place[place >= 0]]]
    return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys * _U(0x9E3779B97F4A7C15) >> _U(64 - size.bit_length() + 1)).view(np.int64)


def find(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's slot, -1 if absent."""
    at = _slot(keys, len(slots))
    left = np.flatnonzero(slots[at] != keys)
    here, key = at[left], keys[left]
    while len(left):
        some = slots[here] != ~_U(0)
        at[left[~some]] = -1
        left, here, key = left[some], (here[some] + 1) & (len(slots) - 1), key[some]
        other = slots[here] != key
        at[left[~other]] = here[~other]
        left, here, key = left[other], here[other], key[other]
    return at


def trie(levels: list[tuple[np.ndarray, np.ndarray]], whole: list[bool]) -> dict[str, np.ndarray]:
    """The arrays of a trie from the grams (context << 8 | byte, sorted) of each context length and their counts. whole: whether a length has all its contexts.

    A context has its total, its distinct bytes, and what those bytes hold of the next shorter context (``excluded``).
    The longest contexts keep logarithms, the others counts.
    """
    out = {"whole": np.array(whole)}
    for k, (keys, counts) in enumerate(levels):
        contexts, first = np.unique(keys >> _U(8), return_index=True)
        total = np.add.reduceat(counts, first) if len(keys) else np.zeros(0, np.int64)
        distinct = np.diff(np.append(first, len(keys)))
        excluded = np.zeros(len(contexts), np.int64)
        if k and len(keys):
            below = levels[k - 1]
            excluded = np.add.reduceat(below[1][np.searchsorted(below[0], keys & _U((1 << 8 * k) - 1))], first)
        of = {"log": np.log10(counts / np.repeat(total + distinct, distinct))} if k == ORDER else {"n": counts}
        for name, values in table(keys, counts, of).items():
            out[f"entry{k}.{name}"] = values
        for name, values in table(contexts, total, {"total": total, "distinct": distinct, "excluded": excluded}).items():
            out[f"node{k}.{name}"] = values
    return out


def shorter(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams of every context length with their counts, from those at the longest context of each byte."""
    out = [grams[ORDER]]
    for k in range(ORDER - 1, -1, -1):
        keys, counts = out[-1]
        out.append(merged([(keys & _U((1 << 8 * (k + 1)) - 1), counts), grams[k]]))
    return out[::-1]


def code(model: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each byte, zero where the model lacks its context; the places where it does, and the grams there."""
    out, length = np.zeros(len(data)), context_lengths(len(data), starts)
    places, missing = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    slots, logs = model[f"entry{ORDER}.keys"], model[f"entry{ORDER}.log"]
    for a, b, grams in blocks(data):
        # Most bytes end here, found in the longest context.
        at = find(slots, grams)
        at[length[a:b] < ORDER] = -1
        left = np.flatnonzero(at < 0)
        here = out[a:b]
        np.take(logs, np.maximum(at, 0), out=here)
        here[left], unknown = _escaping(model, grams[left], length[a:b][left])
        places.append(a + left[unknown])
        missing.append(tagged(grams[left[unknown]], length[a:b][left[unknown]]).view(np.int64))
    return out, np.concatenate(places), np.concatenate(missing)


def _escaping(model, grams, length) -> tuple[np.ndarray, np.ndarray]:
    """The same for bytes of any context length; and which of them have a context that the model lacks."""
    log, unknown = np.zeros(len(grams)), np.zeros(len(grams), bool)
    ex_n, ex_d, open_ = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
    for k in range(ORDER, -1, -1):
        at = np.flatnonzero(open_ & (length >= k))
        gram = grams[at] & _U((1 << 8 * (k + 1)) - 1)
        node = find(model[f"node{k}.keys"], gram >> _U(8))
        if not model["whole"][k]:
            lacks = at[(node < 0) & (length[at] == k)]
            unknown[lacks], open_[lacks] = True, False
        at, gram, node = at[node >= 0], gram[node >= 0], node[node >= 0]
        total, distinct, excluded = (model[f"node{k}.{name}"][node].astype(np.int64) for name in ("total", "distinct", "excluded"))
        n, d = total - ex_n[at], distinct - ex_d[at]
        entry = find(model[f"entry{k}.keys"], gram)
        hit = entry >= 0
        if k < ORDER:
            log[at[hit]] += np.log10(model[f"entry{k}.n"][entry[hit]] / (n + d)[hit])
        else:
            log[at[hit]] = model[f"entry{k}.log"][entry[hit]]
        open_[at[hit]] = False
        escapes = ~hit & (d > 0)
        log[at[escapes]] += np.log10((d / np.maximum(n + d, 1))[escapes])
        ex_n[at[~hit]], ex_d[at[~hit]] = excluded[~hit], distinct[~hit]
    log[open_] -= np.log10(256 - ex_d[open_])
    return log, unknown


def count_corpus(docs: DataFrame, fold: int = FOLD) -> DataFrame:
    """(key, n): how often each word (negative keys) and each gram (others) occurs in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for whole in batches:
            for batch in pieces(whole, 0, PIECE_BYTES):
                held.append(count_texts(batch.column(0)))
                if sum(len(keys) for keys, _ in held) > 2 * HELD:
                    held = [merged(held)]
                if len(held) == 1 and len(held[0][0]) > HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), names=["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged(held))), names=["key", "n"])
        del held
        release()

    train = docs.where(bucket_of("doc_id") != fold).select(F.col("text").cast("string").cast("binary"))
    return train.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int, size=None) -> int:
    """The least power of two t such that rows with n >= t, each of ``size`` entries, have ``most`` entries or fewer. Reads a histogram of 64 rows."""
    size = F.lit(1) if size is None else size
    rows = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("b")).agg(F.sum(size).alias("s")).collect()
    total, t = 0, 63
    for r in sorted(rows, key=lambda r: -r.b):
        total += r.s
        if total > most:
            return 1 << (r.b + 1)
        t = r.b
    return 1


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a bounded table, on the driver."""
    got = rows.select("key", "n").toArrow()
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order].view(_U), n[order]


def _low(column, k: int):
    """The gram with k bytes before its byte, of a longer one."""
    return column.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


class Grams:
    """All grams by context length: as arrays where there are no more than ``capacity``, else as tables, whose frequent contexts go to the executors."""

    def __init__(self, counts: DataFrame, n_grams: int, capacity: int):
        grams = counts.where("key >= 0")
        self.whole, self.frames = [True] * (ORDER + 1), None
        if n_grams <= capacity:
            keys, n = _sorted(grams)
            edges = np.searchsorted(keys, np.arange(ORDER + 2, dtype=_U) << _U(LENGTH))
            self.levels = shorter([(keys[a:b] & _U((1 << LENGTH) - 1), n[a:b]) for a, b in zip(edges, edges[1:])])
            return
        at = F.shiftrightunsigned("key", LENGTH)
        frames: list = [None] * (ORDER + 1)
        for k in range(ORDER, -1, -1):
            own = grams.where(at == k).select(_low(F.col("key"), ORDER).alias("key"), "n")
            frames[k] = own if k == ORDER else cut(frames[k + 1].select(_low(F.col("key"), k).alias("key"), "n").unionByName(own).groupBy("key").agg(F.sum("n").alias("n")))
        self.frames, self.levels, limit = frames, [], 1
        for k in range(ORDER + 1):
            nodes = frames[k].groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size"))
            # Limits rise with the length, so that of a context that stays all shorter ones do.
            limit = max(limit, _threshold(nodes, capacity, F.col("size")))
            self.whole[k] = limit == 1
            self.levels.append(_sorted(frames[k] if limit == 1 else frames[k].join(nodes.where(F.col("n") >= limit).select("context"), F.shiftrightunsigned("key", 8) == F.col("context"), "left_semi")))

    def probabilities(self, missing: DataFrame) -> DataFrame:
        """(key, value): log10 probabilities of distinct tagged grams, by joins with the tables, longest contexts first."""
        rows = missing.select(F.col("key"), F.shiftrightunsigned("key", LENGTH).alias("k"), _low(F.col("key"), ORDER).alias("gram"), F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("ex_n"), F.lit(0).cast("long").alias("ex_d"), F.lit(True).alias("open"))
        for k in range(ORDER, -1, -1):
            own = _low(F.col("gram"), k)
            rows = rows.withColumns({"entry": F.when(F.col("open") & (F.col("k") >= k), own)}).withColumn("context", F.shiftrightunsigned("entry", 8))
            asked = rows.select("context").where("context is not null").distinct()
            held = self.frames[k].withColumn("context", F.shiftrightunsigned("key", 8)).join(asked, "context", "left_semi")
            if k:
                below = self.frames[k - 1].select(F.col("key").alias("low"), F.col("n").alias("low_n"))
                held = held.withColumn("low", _low(F.col("key"), k - 1)).join(below, "low")
            else:
                held = held.withColumn("low_n", F.lit(0))
            nodes = held.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("low_n").alias("excluded"))
            rows = rows.join(nodes, "context", "left").join(self.frames[k].select(F.col("key").alias("entry"), F.col("n").alias("hit")), "entry", "left")
            n, d = F.col("total") - F.col("ex_n"), F.col("distinct") - F.col("ex_d")
            hit, escapes = F.col("hit").isNotNull(), F.col("hit").isNull() & F.col("total").isNotNull()
            rows = rows.select(
                "key", "k", "gram",
                (F.col("log") + F.when(hit, F.log10(F.col("hit") / (n + d))).when(escapes & (d > 0), F.log10(d / (n + d))).otherwise(0.0)).alias("log"),
                F.when(escapes, F.col("excluded")).otherwise(F.col("ex_n")).alias("ex_n"), F.when(escapes, F.col("distinct")).otherwise(F.col("ex_d")).alias("ex_d"), (F.col("open") & ~hit).alias("open"),
            )
        return rows.select("key", (F.col("log") - F.when(F.col("open"), F.log10(256 - F.col("ex_d"))).otherwise(0.0)).alias("value"))


class Shared:
    """Arrays that the driver hands to all workers as one file, which they map into memory. Needs a checkpoint folder."""

    def __init__(self, sc: SparkContext, arrays: dict[str, np.ndarray]):
        self.name, self.places, at = f"ppm-{uuid.uuid4().hex}", {}, 0
        for name, x in arrays.items():
            self.places[name] = (x.dtype.str, len(x), at)
            at += -(-x.nbytes // 64) * 64
        # A shared folder that is mounted is one file for all; else it goes out from Spark's own folder on the driver, where broadcasts start from too.
        shared = re.fullmatch(r"(?:file:/*)?(/.*)", sc.getCheckpointDir() or "")
        self.mounted = re.sub("^/+", "/", shared[1]) if shared else None
        path = os.path.join(self.mounted or sc._temp_dir, self.name)
        with open(path, "wb") as f:
            for name, x in arrays.items():
                f.seek(self.places[name][2])
                f.write(x.data)
            f.truncate(max(at, 1))
        if not self.mounted:
            sc.addFile(path)

    def open(self) -> dict[str, np.ndarray]:
        with open(os.path.join(self.mounted, self.name) if self.mounted else SparkFiles.get(self.name), "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return {name: np.frombuffer(held, dtype, n, at) for name, (dtype, n, at) in self.places.items()}


def counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of text and key, and how often they occur."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(text) else order
    return text[first], key[first], np.diff(np.append(first, len(text)))


def score_documents(docs: DataFrame, fold: int = FOLD, capacity: int = CAPACITY, common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    ensure_checkpoint_dir(docs.sparkSession)
    counts = cut(count_corpus(docs, fold))
    word = F.col("key") < 0
    whole = counts.agg(F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("n"), F.count(F.when(word, 1)).alias("v"), F.count(F.when(~word, 1)).alias("grams")).first()
    words = counts.where(word)
    least = 1 if whole.v <= common else _threshold(words, common)
    keys, n = _sorted(words if least == 1 else words.where(F.col("n") >= least))
    arrays = {f"word.{name}": x for name, x in table(keys, n, {"n": n}).items()}
    grams = Grams(counts, whole.grams, capacity)
    model = Shared(docs.sparkSession.sparkContext, arrays | trie(grams.levels, grams.whole))
    del arrays, keys, n
    grams.levels = None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.open()
        for all_ in batches:
            for batch in pieces(all_, 3, PIECE_BYTES):
                m = batch.num_rows
                if not m:
                    continue
                uid = batch.column(0).to_numpy()
                data, starts = sequence(batch.column(3))
                bits, places, missing = code(arrays, data, starts)
                key, begin = word_keys(data)
                text = np.searchsorted(starts, begin, "right") - 1
                at = find(arrays["word.keys"], key.view(_U))
                known = at >= 0
                rare = counted(text[~known], key[~known])
                lacks = counted(np.searchsorted(starts, places, "right") - 1, missing)
                text_of, key_of, times = (np.concatenate(x) for x in zip(rare, lacks))
                r = len(text_of)
                base = np.bincount(text[known], np.log10(arrays["word.n"][at[known]] + 0.5), m)
                # A document's own row has its number for a key, and counts for nothing there, so that such rows spread over all tasks.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([uid, uid[text_of]])), pa.array(np.concatenate([uid, key_of])), pa.array(np.concatenate([np.zeros(m, np.int64), times])),
                        pa.concat_arrays([batch.column(1), pa.nulls(r, pa.int64())]), pa.concat_arrays([batch.column(2), pa.nulls(r, pa.bool_())]),
                        pa.concat_arrays([pa.array(np.bincount(text, minlength=m)), pa.nulls(r, pa.int64())]), pa.array(np.concatenate([np.bincount(text[known], minlength=m), np.zeros(r, np.int64)])),
                        pa.array(np.concatenate([base, np.zeros(r)])), pa.array(np.concatenate([np.add.reduceat(bits, starts), np.zeros(r)])),
                    ],
                    names=["uid", "key", "tf", "doc_id", "held_out", "n_tokens", "known", "base", "score"],
                )
        release()

    schema = "uid long, key long, tf long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), (bucket_of("doc_id") == fold).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(score, schema)
    values = (words.where(F.col("n") < least) if least > 1 else words.limit(0)).select("key", F.log10(F.col("n") + 0.5).alias("value"))
    if not all(grams.whole):
        rows = cut(rows)
        values = values.unionByName(grams.probabilities(rows.where("key >= 0 and tf > 0").select("key").distinct()))
    gram = F.col("key") >= 0
    seen = rows.join(values, "key", "left").select(
        "uid", "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.when(F.col("value").isNotNull() & ~gram, F.col("tf")).otherwise(0)).alias("known"),
        (F.col("base") + F.when(~gram, F.col("tf") * F.coalesce("value", F.log10(F.lit(0.5)))).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(gram & (F.col("tf") > 0), F.col("tf") * F.col("value")).otherwise(0.0)).alias("score"),
    )
    by_doc = seen.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    each = F.log10(F.lit(whole.n + 0.5 * (whole.v + 1)))
    return by_doc.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(whole.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score")

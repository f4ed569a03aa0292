"""A byte-level convolutional network that scores documents for quality, in numpy.

The network sees a text's bytes through learned filters ``WIDTH`` bytes wide, at
every position. A filter's response is its strongest over the whole document
(max pooling) and its mean over the document after a rectifier; a small dense
layer turns both into one probability. Texts are taken in chunks of ``CHUNK``
bytes that overlap by ``WIDTH - 1``, so that every position of every text is
seen once and memory does not follow the length of a text.

The filters, offsets and dense weights are learned by Adam from labelled rows.
At most ``TRAIN_ROWS`` labelled rows are used, those with the least hash of
their id, so that the choice follows neither file order nor partitioning, and of these as
many, in this order, as have ``TRAIN_BYTES`` bytes together, as they are held on the driver. Every
text that is learned from is learned from whole, chunk by chunk.

Null and empty texts are scored by the responses of an empty document, all
zero. Documents without a label are scored like any other. Labels, language,
source and id are not inputs. With no labelled row every score is 0.5. Of rows
that share an id the least text is learned from, with the least label; each is scored on its own. Other
columns of either table are not read, whatever their names. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import bucket_of, buffer, cut, pieces

WIDTH, FILTERS, HIDDEN = 6, 16, 16
CHUNK = 1 << 15
TRAIN_ROWS, TRAIN_BYTES = 2400, 64 << 20
EPOCHS, BATCH, RATE, SEED = 8, 48, 0.01, 7
THRESHOLD = 0.3
PIECE_BYTES = 8 << 20
#: Positions whose gradients are gathered together.
GATHERED = 1 << 15
#: Parts of a batch that the driver works on side by side; their sums are added in order.
PARTS = 4


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "table": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),  # what each byte at each place adds to each filter
            "offset": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, (2 / (2 * FILTERS)) ** 0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """Rectified responses at each position of a chunk; a text shorter than a filter is filled up with zero bytes."""
        if len(data) < WIDTH:
            data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
        n = len(data) - WIDTH + 1
        out = self.p["table"][0][data[:n]]
        for k in range(1, WIDTH):
            out += self.p["table"][k][data[k : k + n]]
        out += self.p["offset"]
        return np.maximum(out, 0, out=out)

    def chunks(self, data: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
        """(position, responses from there on) of overlapping chunks."""
        for at in range(0, max(1, len(data) - WIDTH + 1), chunk):
            yield at, self.convolve(data[at : at + chunk + WIDTH - 1])

    def pool(self, data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Strongest and mean responses over a whole document."""
        if not len(data):
            return np.zeros(2 * FILTERS, np.float32)
        top, total, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0
        for _, r in self.chunks(data, chunk):
            np.maximum(top, r.max(axis=0), out=top)
            total += r.sum(axis=0, dtype=np.float32)
            n += len(r)
        return np.concatenate([top, (total / n).astype(np.float32)])

    def dense(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.p["w1"] + self.p["b1"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"][0], -30, 30)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, chunk: int = CHUNK, batch: int = 0) -> tuple[dict, float]:
        """Gradients of the weighted log loss over some texts. Max pooling passes them to one position of each filter, the mean to all that fire. batch: texts of the batch that these are a part of."""
        texts = [np.concatenate([t, np.zeros(WIDTH - len(t), np.uint8)]) if len(t) < WIDTH else t for t in texts]
        held, tops, pooled = [], [], []
        filters = np.arange(FILTERS)
        for t in texts:
            top, best, total = np.full(FILTERS, -1.0), np.zeros(FILTERS, np.int64), np.zeros(FILTERS)
            for at, r in self.chunks(t, chunk):
                here = r.argmax(axis=0)
                higher = r[here, filters] > top
                top[higher], best[higher] = r[here, filters][higher], at + here[higher]
                total += r.sum(axis=0)
            held.append(r if at == 0 else None)  # responses of long texts are computed again
            tops.append((top, best))
            pooled.append(np.concatenate([top, total / (len(t) - WIDTH + 1)]))
        pooled = np.stack(pooled).astype(self.p["w1"].dtype)
        hidden, score = self.dense(pooled)
        loss = -(weights * np.log(np.where(labels == 1, score, 1 - score) + 1e-9)).mean()
        d = ((score - labels) * weights / (batch or len(labels))).astype(np.float32)
        dh = d[:, None] * self.p["w2"] * (hidden > 0)
        g = {"w2": hidden.T @ d, "b2": np.array([d.sum()]), "w1": pooled.T @ dh, "b1": dh.sum(axis=0)}
        dp = dh @ self.p["w1"].T
        g |= {"table": np.zeros_like(self.p["table"]), "offset": np.zeros(FILTERS, np.float32)}
        near, size = [], 0
        for data, r, (top, best), one in zip(texts, held, tops, dp):
            mean, most = one[FILTERS:] / (len(data) - WIDTH + 1), one[:FILTERS] * (top > 0)
            for at, r_ in [(0, r)] if r is not None else self.chunks(data, chunk):
                # What each position passes on; the last bytes of a chunk begin no window.
                back = np.zeros((len(r_) + WIDTH - 1, FILTERS), np.float32)
                np.multiply(r_ > 0, mean, out=back[: len(r_)])
                here = np.flatnonzero((best >= at) & (best < at + len(r_)))
                back[best[here] - at, here] += most[here]
                near.append((data[at : at + len(back)], back))
                size += len(back)
                if size >= GATHERED:
                    self._pass_on(near, g)
                    near, size = [], 0
        if near:
            self._pass_on(near, g)
        return g, float(loss)

    @staticmethod
    def _pass_on(near: list[tuple[np.ndarray, np.ndarray]], g: dict) -> None:
        """Adds what positions pass on to the gradients of the bytes under their windows, all positions of a byte together."""
        data, back = np.concatenate([d for d, _ in near]), np.concatenate([np.zeros((WIDTH - 1, FILTERS), np.float32), *(b for _, b in near)])
        # What the windows over a position pass on lies in a row; the last byte of a window is its first row.
        over = as_strided(back, (len(data), WIDTH * FILTERS), back.strides)
        order, ends = np.argsort(data, kind="stable"), np.cumsum(np.bincount(data, minlength=256))
        for byte in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            rows = order[ends[byte - 1] if byte else 0 : ends[byte]]
            g["table"][::-1, byte] += np.add.reduce(over[rows], axis=0).reshape(WIDTH, FILTERS)
        g["offset"] += back.sum(axis=0)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        share = np.clip(labels.mean(), 0.02, 0.98)
        # Both labels weigh something like the same, softened so that scores stay near probabilities.
        weights = np.where(labels == 1, (1 - share) ** 0.5, share**0.5)
        weights = weights / weights.mean()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(texts) // BATCH)
        pool = ThreadPoolExecutor(PARTS)  # numpy's work runs side by side
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                parts = pool.map(lambda p, n=len(pick): self.gradients([texts[i] for i in p], labels[p], weights[p], batch=n)[0], np.array_split(pick, min(PARTS, len(pick))))
                g = {k: sum(x) for k, *x in zip(self.p, *((part[k] for k in self.p) for part in parts))}
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
                for k, v in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.01 * (g[k] ** 2 - s[k])
                    v -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
        pool.shutdown()
        return self

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.dense(np.stack([self.pool(t) for t in texts]))[1].astype(float) if texts else np.zeros(0)


def fitting(ids: list[int], sizes: list[int], most: int) -> list[int]:
    """Documents in turn whose texts fit into ``most`` bytes together. One that does not fit leaves room for those after it; where none fits, the shortest is taken."""
    taken, left = [], most
    for k, n in zip(ids, sizes):
        if n <= left:
            taken.append(k)
            left -= n
    return taken or [k for _, k in sorted(zip(sizes, ids))[:1]]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, most: int = TRAIN_BYTES) -> Network | None:
    """A network from at most ``rows`` labelled documents of ``most`` bytes together, outside the held-out fold; None without any."""
    picked = (
        labels.where((bucket_of("doc_id") != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("turn"))
    )
    # At most ``rows`` ids, so this side is small whatever the corpus. Rows that share an id become one before they leave their tasks.
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    found = cut(found.groupBy("turn", "doc_id", "quality").agg(F.min("text").alias("text")))
    sizes = found.select("turn", "doc_id", F.octet_length("text").alias("n")).toPandas().sort_values(["turn", "doc_id"])
    ids = fitting(sizes["doc_id"].tolist(), sizes["n"].tolist(), most)
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame([(k,) for k in ids], "doc_id long")
    table = found.join(F.broadcast(chosen), "doc_id", "left_semi").toPandas().sort_values(["turn", "doc_id"])
    return Network().fit([np.frombuffer(t, np.uint8) for t in table["text"]], table["quality"].to_numpy(np.float32), epochs)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    network = train(docs, labels, rows, epochs)
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_BYTES):
                data, at = buffer(batch.column(2))
                texts = [data[a:b] for a, b in zip(at, at[1:])]
                score = net.score(texts) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = docs.select(F.col("doc_id").cast("long"), (bucket_of("doc_id") == 0).alias("held_out"), F.col("text").cast("string"))
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

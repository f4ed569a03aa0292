"""SimHash near duplicates by BK-trees.

A fingerprint has 64 bits, each the majority of that bit in the hashes of the
text's word shingles. Two documents link when their fingerprints differ in
``radius`` bits or fewer; groups are the connected components of the links.

Equal fingerprints are one node. Fingerprints cut into ``radius + 1`` blocks
agree in one block at least when they link, so each block's values deal the
nodes into buckets, and a bucket is a shard with a BK-tree of its own: children
keyed by their integer Hamming distance to the parent, searches following only
the edges within the radius of the distance at hand. A bucket of more than
``most`` nodes is dealt again by the blocks of the bits that remain, and again, which
loses no link by the same argument. A bucket's tree thus has a bounded size
and goes to the one task that holds its nodes; a tree of all shards broadcast to
every executor would grow with the corpus. Buckets give only stars, each node
with the least node that it reaches, so a group of copies costs rows in
proportion to its size.

``near_copies`` finds copies by the similarity of their sets of word shingles,
down to 0.8, at which fingerprints of 64 bits differ in ten bits or so. No few
blocks agree at that distance, so there the buckets are dealt by least shingle
hashes: copies share one of ``KEYS`` of them with a probability of
1 - (1 - similarity) ** KEYS. In a bucket of very many each document first meets
a few leaders. What a sketch puts at 0.8 of a leader needs no other comparison:
by the triangle inequality its copies lie within 0.6 of that leader, and all
that may lie there are candidates as well. If very many remain, such as those of
a common line, the bucket is dealt by a second hash, any of ``KEYS + EXTRA - 1``
others, of which copies miss all with a probability of 4e-9; and what is too
large even then goes out by pairs of its blocks, so that any two meet. Within a bucket the BK-tree finds what lies within
``WIDE`` bits, and a sketch of ``BINS`` least hashes, one byte each, tells which
of these pairs may be copies. What such pairs connect is a cluster, and within a
cluster only a similarity counted on the whole sets of shingle hashes links. A
large cluster is dealt by blocks: those of its largest family of copies meet all others, so that any two
members that no links connect yet meet.

Null and empty texts have fingerprint zero and link like any other. A null id
is a document of its own group with a null component when nothing else links.
Texts are processed whole, shingles counted with repeats; by ``near_copies``
once each, as its similarity is one of sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.llm.common import cut, ensure_checkpoint_dir, pieces, strings
from noteloom.llm.components import components, roots, unite

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Nodes of a bucket beyond which it is dealt again, or goes out by pairs of its blocks.
MOST = 4096
#: Nodes of the buckets that one call of the search takes together, and pairs that a search may look at together, about.
BLOCK, FRONTIER = 20_000, 2_000_000
#: Rows of a bucket of copies beyond which it is split; buckets that are broadcast at most (more are joined by a shuffle, with the same result).
MANY, MOST_MANY = 512, 100_000
#: For copies by similarity: words of a shingle, similarity, bits, least hashes that deal, bins of a sketch.
COPY_SHINGLE, SIMILARITY, WIDE, KEYS, BINS = 5, 0.8, 24, 5, 128
#: Standard deviations by which a sketch may fall short of the similarity and still make a candidate.
DEVIATIONS = 4
#: Leaders of a large bucket, and least hashes by which it may be dealt besides ``KEYS``.
LEADERS, EXTRA = 4, 8
#: Documents and shingles of a block of a cluster, about; members of a family that stand for it first; bytes of sets that one call takes together.
TOGETHER, SHINGLES, FEW, HELD_BYTES = 1024, 1 << 20, 8, 16 << 20
PIECE_BYTES = 8 << 20
_ROWS = 16_384


def shingles(text: str, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, a stretch at a time."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _ROWS):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _ROWS], stops[at : at + _ROWS])], np.uint64)


def majority(stretches: Iterator[np.ndarray]) -> int:
    """The number whose bits are set in over half of the hashes, zero without any."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in stretches:
        n += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_BYTES):
                fps = np.array([fingerprint(t, shingle, seed) for t in strings(batch.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees over the values of each group, one tree for each, built level by level.

    tree node k holds item ``item[k]``; its child at distance d is found under
    ``k * 65 + d`` in the sorted ``edge``, at tree node ``first + position``.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        items = np.arange(len(values))
        keys, label = np.unique(group, return_inverse=True)
        self.root, self.first = label, len(keys)
        nodes, edges, base = [], [], 0
        while len(items):
            order = np.argsort(label, kind="stable")
            items, label = items[order], label[order]
            head = np.ones(len(items), bool)
            head[1:] = label[1:] != label[:-1]
            pivots = items[head]
            nodes.append(pivots)
            rest, of = items[~head], label[~head]
            apart = np.bitwise_count(values[rest] ^ values[pivots[of]]).astype(np.int64)
            keys, label = np.unique((base + of) * 65 + apart, return_inverse=True)
            edges.append(keys)
            items, base = rest, base + len(pivots)
        self.item = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of items (query, other) of one group whose values differ in ``radius`` bits or fewer, the query itself left out."""
        q, node, found = queries, self.root[queries], []
        while len(q):
            other = self.item[node]
            d = np.bitwise_count(self.values[q] ^ self.values[other]).astype(np.int64)
            hit = (d <= radius) & (q != other)
            found.append((q[hit], other[hit]))
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - lo
            q = np.repeat(q, n)
            node = self.first + np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (queries, queries)


def stars(values: np.ndarray, group: np.ndarray, radius: int = RADIUS, frontier: int = FRONTIER) -> np.ndarray:
    """For each item the index of the least item that it reaches by links within its group."""
    parent = np.arange(len(values))
    if not len(values):
        return parent
    forest = BKForest(values, group)
    sizes = np.bincount(forest.root)[forest.root]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + frontier, "right")))
        parent = unite(parent, *forest.within(np.arange(at, to), radius))
        at = to
    return roots(parent)


def deal(rows: DataFrame, parts: int) -> DataFrame:
    """Each of ``rows`` (node, fp, rest, bits, b1, b2) once for each of ``parts`` blocks of the ``bits`` bits of ``rest``, in the bucket of the block's value within its bucket; rest and bits without that block."""

    def block(k: int):
        low, high = (F.expr(f"cast(bits * {j} div {parts} as int)") for j in (k, k + 1))
        ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
        value = F.call_function("shiftrightunsigned", "rest", low).bitwiseAND(ones(high - low))
        above = F.when(high < 64, F.call_function("shiftleft", F.call_function("shiftrightunsigned", "rest", high), low)).otherwise(F.lit(0).cast("long"))
        of = (F.lit(k), value)
        return F.struct(above.bitwiseOR(F.col("rest").bitwiseAND(ones(low))).alias("rest"), (F.col("bits") - (high - low)).alias("bits"), F.xxhash64("b1", *of).alias("b1"), F.hash("b2", *of).alias("b2"))

    return rows.select("node", "fp", F.explode(F.array(*map(block, range(parts)))).alias("x")).select("node", "fp", "x.*")


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Stars (a, b) over nodes (node, fp) with distinct fp: a's links within each bucket, b the least node reached there.

    Buckets of more than ``most`` nodes are dealt again until there are none, or until the bits that
    remain are as few as the blocks; with the usual ``most`` no bucket is larger then, as fingerprints are distinct.
    """
    rows = nodes.select("node", "fp", F.col("fp").alias("rest"), F.lit(64).alias("bits"), F.lit(0).cast("long").alias("b1"), F.lit(0).alias("b2"))
    dealt = None
    while True:
        rows = deal(rows, radius + 1)
        hot = cut(rows.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most))
        if n_hot := hot.count():
            rows = rows.join(F.broadcast(hot) if n_hot <= MOST_MANY else hot, ["b1", "b2"], "left")
            again = F.col("size").isNotNull() & (F.col("bits") > radius + 1)
            done, rows = rows.where(~again), cut(rows.where(again).drop("size"))
        else:
            done = rows
        done = done.select("node", "fp", "b1", "b2")
        dealt = done if dealt is None else dealt.unionByName(done)
        if not n_hot or rows.isEmpty():
            break

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(rows: pa.Table) -> pa.RecordBatch:
            b1, b2, node = (rows.column(c).to_numpy() for c in ("b1", "b2", "node"))
            new = np.ones(len(b1), bool)
            new[1:] = (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
            to = stars(rows.column("fp").to_numpy().view(np.uint64), np.cumsum(new), radius)
            own = to != np.arange(len(to))
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[to[own]])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= BLOCK:
                b1, b2 = held.column("b1").to_numpy(), held.column("b2").to_numpy()
                last = np.flatnonzero((b1 != b1[-1]) | (b2 != b2[-1]))
                if len(last):  # the last bucket may go on in the next batch
                    yield star(held.slice(0, last[-1] + 1).combine_chunks())
                    held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield star(held.combine_chunks())

    return dealt.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "node").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach from the document."""
    ensure_checkpoint_dir(docs.sparkSession)
    fps = cut(fingerprints(docs, shingle, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node is not null"), radius, most))
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_ODD = np.random.default_rng(SEED).integers(1, 1 << 62, KEYS + EXTRA, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    stretches = list(shingles(text, COPY_SHINGLE))
    return np.unique(np.concatenate(stretches)) if stretches else np.zeros(0, np.uint64)


def mark(h: np.ndarray) -> int:
    """A number for a set of shingles."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def sketch(h: np.ndarray) -> tuple[int, list[int], bytes]:
    """Of a set of shingles the fingerprint, least hashes under ``KEYS + EXTRA`` orders, and a byte of the least hash of each bin, zero for an empty bin."""
    least = np.zeros(BINS, np.uint8)
    if not len(h):
        return 0, [0] * len(_ODD), least.tobytes()
    keys = [int((h * odd ^ h * odd >> np.uint64(31)).min()) for odd in _ODD]
    # Sorted hashes come bin by bin, least first.
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    least[bins[first]] = np.maximum((h[first] >> np.uint64(40)).astype(np.uint8), 1)
    return majority(iter([h])), keys, least.tobytes()


def estimate(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of pairs of sketches (rows, BINS), and the standard deviation for pairs of ``similarity``."""
    either = np.maximum(((a | b) > 0).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return same / either, np.sqrt(similarity * (1 - similarity) / either)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of sketches may reach a similarity: a generous choice, to be verified."""
    share, deviation = estimate(a, b, similarity)
    return share >= similarity - DEVIATIONS * deviation


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the index of the least one that links reach, a link being a similarity of at least ``similarity``.

    A set is compared with those only that no link has reached yet, so a group
    of copies takes steps in proportion to its size.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    own = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    label, left = np.full(len(sets), -1), np.arange(len(sets))
    while len(left):
        root = int(left[0])
        label[root], left, queue = root, left[1:], [root]
        while queue and len(left):
            x = queue.pop()
            mine = ids[starts[x] : starts[x] + sizes[x]]
            own[mine] = True
            fit = left[np.minimum(sizes[left], sizes[x]) >= similarity * np.maximum(sizes[left], sizes[x]) - 1e-9]
            ends = np.cumsum(sizes[fit])
            both = np.concatenate([[0], np.cumsum(own[ids[np.repeat(starts[fit] - ends + sizes[fit], sizes[fit]) + np.arange(ends[-1] if len(ends) else 0)]])])
            both = both[ends] - both[ends - sizes[fit]]
            own[mine] = False
            hit = fit[both >= similarity * (sizes[x] + sizes[fit] - both) - 1e-9]
            label[hit] = root
            queue += hit.tolist()
            left = left[label[left] < 0]
    return label


def groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], held_bytes: int) -> Iterator[pa.Table]:
    """Rows that come sorted by ``columns``, about ``held_bytes`` at a time, those of one value together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= held_bytes:
            rows = pa.Table.from_batches(held).combine_chunks()
            other = np.zeros(rows.num_rows, bool)
            for c in columns:
                values = rows.column(c).to_numpy()
                other |= values != values[-1]
            last = np.flatnonzero(other)
            if len(last):  # the last value may go on in the next batch
                yield rows.slice(0, last[-1] + 1)
                rows = rows.slice(last[-1] + 1)
            held = rows.to_batches()
            size = rows.nbytes if len(last) else 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rows


def link(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (component, part, node, mark, set) that come sorted so: b the least node that links reach from a among those of one component and part."""
    for rows in groups(batches, ("component", "part"), HELD_BYTES):
        component, part, node, of = (rows.column(c).to_numpy() for c in ("component", "part", "node", "mark"))
        column = rows.column("set")
        edges = np.flatnonzero(np.concatenate([[True], (component[1:] != component[:-1]) | (part[1:] != part[:-1]), [True]]))
        a, b = [], []
        for low, high in zip(edges.tolist(), edges[1:].tolist()):
            # Equal texts of one id come once for each of its rows.
            pick = low + np.flatnonzero(np.concatenate([[True], (of[low + 1 : high] != of[low : high - 1]) | (node[low + 1 : high] != node[low : high - 1])]))
            to = pick[alike([np.frombuffer(column[k].as_buffer(), np.uint64) for k in pick.tolist()], similarity)]
            a.append(node[pick[to != pick]])
            b.append(node[to[to != pick]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def verified(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) between the nodes of each cluster, b the least node that pairs of that similarity, counted on whole sets, reach from a.

    A large cluster is linked block by block, and then among some members of each
    family found so. What these make of it is mostly one family of copies; only those outside the largest one
    still have to meet all others, and no two of its members each other.
    """
    members = nodes.join(clusters, "node").select("mark", "node", "n", "component")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / together, F.sum("n") / SHINGLES)).cast("int")
    large = cut(members.groupBy("component").agg(parts.alias("parts")).where("parts > 1"))
    n_large = large.count()
    small_side = (lambda frame: F.broadcast(frame)) if n_large <= MOST_MANY else (lambda frame: frame)
    members = members.join(small_side(large), "component", "left").select(F.col("node").alias("doc_id"), F.col("mark").alias("of"), "component", "parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_BYTES):
                found = [shingle_set(t) for t in strings(batch.column(1))]
                # A repeated id may stand for several texts.
                own = [k for k, (h, of) in enumerate(zip(found, batch.column(2).to_pylist())) if mark(h) == of]
                rest = batch.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([rest.column(0), *rest.columns[2:], pa.array([found[k].tobytes() for k in own], pa.binary())], names=["node", "mark", "component", "parts", "set"])

    def with_sets(of: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(of, "doc_id").select("doc_id", "text", "of", "component", "parts")
        return texts.mapInArrow(sets, "node long, mark long, component long, parts int, set binary")

    def linked(rows: DataFrame) -> DataFrame:
        dealt = rows.select("node", "mark", "component", "part", "set").repartition("component", "part").sortWithinPartitions("component", "part", "node", "mark")
        return dealt.mapInArrow(lambda batches: link(batches, similarity), "a long, b long")

    found = linked(with_sets(members.where("parts is null")).withColumn("part", F.lit(-1).cast("long")))
    if not n_large:
        return found
    rows = cut(with_sets(members.where("parts is not null")))
    block = lambda n: F.pmod(F.xxhash64("mark"), n).cast("long")
    first = cut(linked(rows.withColumn("part", block(F.col("parts")))))
    # Some members of each family of a block, of which there are few for each block.
    family = first.select(F.col("a").alias("node"), F.col("b").alias("family")).unionByName(first.select(F.col("b").alias("node"), F.col("b").alias("family")).distinct())
    few = family.withColumn("place", F.row_number().over(W.partitionBy("family").orderBy(F.xxhash64("node"), "node"))).where(F.col("place") <= FEW).select("node").distinct()
    second = cut(linked(rows.join(few, "node", "left_semi").withColumn("part", F.lit(-1).cast("long"))))
    found = found.unionByName(first).unionByName(second)
    family = components(first.unionByName(second)).select("node", F.col("component").alias("family"))
    of = cut(rows.select("node", "mark", "component").distinct().join(family, "node", "left").withColumn("family", F.coalesce("family", "node")))
    sizes = of.groupBy("component", "family").agg(F.count(F.lit(1)).alias("size"))
    size = sizes.groupBy("component").agg(F.max_by("family", F.struct("size", "family")).alias("largest"), F.max("size").alias("most"), F.sum("size").alias("all")).where(F.col("all") > F.col("most"))
    half = together / 2
    size = size.select("component", "largest", F.ceil((F.col("all") - F.col("most")) / half).alias("n_rest"), F.ceil(F.col("most") / half).alias("n_most"))
    plan = cut(of.join(small_side(size), "component").select("node", "mark", "component", (F.col("family") == F.col("largest")).alias("inside"), "n_rest", "n_most"))
    if plan.isEmpty():
        return found
    # Blocks of the others are numbered before those of the largest family. Pairs of blocks of which one at least is of the others meet.
    own = F.when(F.col("inside"), F.col("n_rest") + block(F.col("n_most"))).otherwise(block(F.col("n_rest")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("inside"), F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_most")) - 1)
    pairs = F.transform(F.filter(others, lambda x: x != own), lambda x: F.least(x, own) * (F.col("n_rest") + F.col("n_most")) + F.greatest(x, own))
    third = rows.join(plan, ["node", "mark", "component"]).select("node", "mark", "component", "set", F.explode(pairs).alias("part"))
    return found.unionByName(linked(third))


def split(nodes: DataFrame, pairs: DataFrame, limit: int, n_rows: int, similarity: float = SIMILARITY, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Rows (node, fp, sketch, b) of buckets in which all copies of a bucket of ``pairs`` (mark, k, b) meet, and the links (a, b) of candidates that need no bucket.

    Buckets of over ``limit`` rows meet leaders and second hashes. What these leave is one bucket up to ``most`` rows, pairs of
    blocks of ``most`` rows beyond: smaller blocks would repeat each row as often as there are others, and compare those of a block again with each.
    Marks alone are dealt; only those that share a bucket get their fingerprints and sketches.
    """

    def heat(rows: DataFrame, most: int) -> DataFrame:
        """``rows``, which are ``most`` at most, with the count of their bucket where it is beyond the limit."""
        hot = rows.groupBy("b").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
        return rows.join(F.broadcast(hot) if most <= limit * MOST_MANY else hot, "b", "left")

    pairs = heat(pairs, n_rows)
    # Only rows of hot buckets need the other least hashes.
    hot = pairs.where("size is not null").drop("size").join(nodes.select("mark", "node", "sketch", "keys"), "mark")
    leaders = hot.groupBy("b").agg(*(F.min_by(F.struct("node", "sketch"), F.xxhash64("node", F.lit(j))).alias(f"l{j}") for j in range(LEADERS)))
    leaders = leaders.select("b", *(F.col(f"l{j}.{c}").alias(f"{c}{j}") for j in range(LEADERS) for c in ("node", "sketch")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own, node = sketches(batch.column("sketch")), batch.column("node").to_numpy()
                stays, a, b = np.ones(len(own), bool), [], []
                for j in range(LEADERS):
                    share, deviation = estimate(own, sketches(batch.column(f"sketch{j}")), similarity)
                    stays &= share < similarity
                    # Both estimates may err: that of the leader with the one left out, and this one.
                    may = share >= 2 * similarity - 1 - 2 * DEVIATIONS * deviation
                    a.append(node[may])
                    b.append(batch.column(f"node{j}").to_numpy()[may])
                rest, a, b = batch.select(["mark", "keys", "k", "b"]).filter(pa.array(stays)), np.concatenate(a), np.concatenate(b)
                none = pa.nulls(rest.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*rest.columns, none, none], names=[*rest.schema.names, "node", "to"])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(a), field.type) for field in rest.schema), pa.array(a), pa.array(b)], names=[*rest.schema.names, "node", "to"])

    met = cut(hot.join(leaders, "b").mapInArrow(meet, "mark long, keys array<long>, k int, b long, node long, to long"))
    rest = heat(met.where("to is null").drop("node", "to"), n_rows)
    # By any second hash; two documents that share the first and one other meet.
    # Two hashes name one bucket whichever of them comes first, so what two hot buckets share is dealt once: of a row all its hot
    # hashes come together, and only the different buckets they name go out.
    key = lambda j: F.element_at("keys", j + 1)
    second = lambda k, j: F.xxhash64(F.least(k, j), key(F.least(k, j)), F.greatest(k, j), key(F.greatest(k, j)))
    others = lambda k: F.filter(F.sequence(F.lit(0), F.lit(KEYS + EXTRA - 1)), lambda j: j != k)
    both = F.array_distinct(F.flatten(F.transform("ks", lambda k: F.transform(others(k), lambda j: second(k, j)))))
    hot = rest.where("size is not null").groupBy("mark").agg(F.collect_set("k").alias("ks"), F.first("keys").alias("keys"))
    again = heat(hot.select("mark", F.explode(both).alias("b")), n_rows * (KEYS + EXTRA - 1))
    parts = F.ceil(F.col("size") / most).cast("int")
    block = F.pmod(F.xxhash64("mark", F.lit(LEADERS)), parts).cast("int")
    blocks = F.transform(F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != block), lambda x: F.xxhash64("b", F.least(x, block), F.greatest(x, block)))
    dealt = again.where(F.col("size") > most).select("mark", F.explode(blocks).alias("b"))
    for part, whole in ((pairs, limit), (rest, limit), (again, most)):
        dealt = part.where(F.col("size").isNull() | (F.col("size") <= whole)).select("mark", "b").unionByName(dealt)
    # Buckets are small by now; most hold one row, which has nothing to meet.
    # Copies mostly share several hashes, so many buckets hold the same rows; of these one is searched.
    dealt = dealt.groupBy("b").agg(F.sort_array(F.collect_set("mark")).alias("marks")).where(F.size("marks") > 1)
    dealt = dealt.groupBy("marks").agg(F.min("b").alias("b")).select("b", F.explode("marks").alias("mark"))
    return dealt.join(nodes.select("mark", "node", "fp", "sketch"), "mark").select("node", "fp", "sketch", "b"), met.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, wide: int = WIDE, many: int = MANY, together: int = TOGETHER, most: int = MOST) -> DataFrame:
    """doc_id and component_id, the smallest id that links of copies reach from the document; a row for each document that has an id."""
    ensure_checkpoint_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PIECE_BYTES):
                sets = [shingle_set(t) for t in strings(batch.column(1))]
                rows = [sketch(h) for h in sets]
                fps = np.array([r[0] for r in rows], np.uint64).view(np.int64)
                keys = np.array([r[1] for r in rows], np.uint64).view(np.int64).tolist() if rows else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([mark(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())],
                    names=["doc_id", "mark", "n", "fp", "keys", "sketch"],
                )

    marked = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "doc_id long, mark long, n long, fp long, keys array<long>, sketch binary"))
    # Texts with the same shingles are one node. Each step below reads them, so they are made once.
    nodes = cut(marked.groupBy("mark").agg(F.min_by(F.struct("n", "fp", "keys", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("node")).select("mark", "node", "s.*"))
    # Read for counts and for each way of dealing, so made once.
    pairs = cut(nodes.select("mark", F.posexplode(F.slice("keys", 1, KEYS)).alias("k", "key")).select("mark", "k", F.xxhash64("k", "key").alias("b")))
    dealt, near = split(nodes, pairs, many, KEYS * marked.count(), similarity, most)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            bucket, node = rows.column("b").to_numpy(), rows.column("node").to_numpy()
            group = np.cumsum(np.diff(bucket, prepend=bucket[0]) != 0)
            fps = rows.column("fp").to_numpy().view(np.uint64)
            looks = sketches(rows.column("sketch"))
            forest = BKForest(fps, group)
            ends = np.cumsum(np.bincount(forest.root)[forest.root])
            parent, at = np.arange(len(fps)), 0
            while at < len(fps):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, "right")))
                q, other = forest.within(np.arange(at, to), wide)
                q, other = q[other < q], other[other < q]
                for low in range(0, len(q), _ROWS):
                    a, b = q[low : low + _ROWS], other[low : low + _ROWS]
                    # What is linked already needs no look.
                    parent = roots(parent)
                    a, b = a[parent[a] != parent[b]], b[parent[a] != parent[b]]
                    ok = similar(looks[a], looks[b], similarity)
                    parent = unite(parent, a[ok], b[ok])
                at = to
            to_ = roots(parent)
            own = to_ != np.arange(len(to_))
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[to_[own]])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= BLOCK:
                bucket = held.column("b").to_numpy()
                last = np.flatnonzero(bucket != bucket[-1])
                if len(last):
                    yield star(held.slice(0, last[-1] + 1))
                    held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield star(held)

    clusters = components(dealt.repartition("b").sortWithinPartitions("b", "node").mapInArrow(search, "a long, b long").unionByName(near))
    found = components(verified(docs, nodes, clusters, similarity, together))
    of = nodes.select("mark", "node").join(found, "node", "left").select("mark", F.coalesce("component", "node").alias("component_id"))
    return marked.select("doc_id", "mark").join(of, "mark").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each group of near copies.

    Rows with one id count as one document; of repeated rows all stay or go.
    A document without an id stays.
    """
    groups = near_copies(docs, **options)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

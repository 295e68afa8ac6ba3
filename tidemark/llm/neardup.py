"""Near duplicates by DartMinHash signatures, a banded join, exact similarities and connected components.

Documents that share a band meet their band's leader first, one pair each. Only where that leaves members of a band apart
are they compared with each other, those of the largest part with the others alone; so a large group of copies costs a
comparison a document, not one a pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, fresh, settle, settled, table, text_of
from .words import BASE, Words, mix, words_of

#: Words of a shingle, and the weighted Jaccard similarity from which documents are linked.
SHINGLE, LEAST = 5, 0.8
#: Coordinates of a signature, coordinates of a band, bands. Of pairs at 0.8 exactly, one in 6,600 shares no band (of pairs
#: at 0.82 one in 27,000), by simulation of this choice of coordinates.
COORDINATES, ROWS, BANDS = 128, 7, 64
#: Documents of a group, and bytes of their shingles, that one task compares at most, about: a larger group is cut into
#: tiles, and a pair of tiles is a task.
TILE, TILE_BYTES = 500, 16 << 20
#: Bytes of a group beyond which memory is given back after it.
SETTLE_BYTES = 1 << 20
#: Groups whose sizes are broadcast at most; those of more groups are joined.
MOST_GROUPS = 100_000


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and the text of each; a text of fewer words is one shingle."""
    hashes, first = w.grams(SHINGLE)
    owner = w.owner[first]
    cuts = w.cuts()
    short = np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < SHINGLE))
    if len(short):
        whole = np.array([_sequence(w.hashes[cuts[i] : cuts[i + 1]]) for i in short.tolist()], np.uint64)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def _sequence(hashes: np.ndarray) -> int:
    """A hash of words in order."""
    up = np.multiply.accumulate(np.full(len(hashes), BASE, np.uint64)) if len(hashes) else np.empty(0, np.uint64)
    return int(mix(np.array([(mix(hashes + np.uint64(1)) * up).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0])


def weights(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle of each text once (by text, then hash), its text, and how often it occurs."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[first], o[first], np.diff(np.append(first, len(h)))


def signatures(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, k: int = COORDINATES, reach: float | None = None) -> np.ndarray:
    """DartMinHash: texts x k dart numbers; two texts agree in a coordinate with their weighted Jaccard similarity.

    An element's darts are a Poisson process over weight and time, the same for every text: in each dyadic strip of
    weights they come one after another, each with a weight within the strip and a coordinate. A text accepts those below
    its element's weight; the earliest per coordinate is its sign. How late a text looks follows from its total weight, so
    that it meets about k ln k darts; where a coordinate stays empty, it looks again, farther.
    """
    reach = k * (math.log(k) + 4) if reach is None else reach
    total = np.bincount(owner, weight, texts)
    until = reach / np.maximum(total, 1)
    earliest, sign = np.full(texts * k, np.inf), np.zeros(texts * k, np.uint64)
    low, width, strip = 0.0, 1.0, 1
    while (weight > low).any():
        at = np.flatnonzero(weight > low)
        time, n = np.zeros(len(at)), 1
        while len(at):
            dart = mix(elements[at] + np.uint64((strip * 0xD6E8FEB86659FD93 + n * 0xA0761D6478BD642F) % (1 << 64)))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) / (1 << 53)) / width
            soon = time <= until[owner[at]]
            at, time, dart = at[soon], time[soon], dart[soon]
            more = mix(dart ^ np.uint64(BASE))
            height = low + width * ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32))
            fine = height < weight[at]
            slot = owner[at[fine]] * k + ((more[fine] >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(earliest, slot, time[fine])
            first = earliest[slot] == time[fine]
            sign[slot[first]] = dart[fine][first]
            n += 1
        low, width, strip = low + width, (low + width), strip + 1
    empty = np.isinf(earliest).reshape(texts, k).any(1) & (total > 0)
    sign = sign.reshape(texts, k)
    if empty.any():
        some = empty[owner]
        again = np.cumsum(empty) - 1
        sign[empty] = signatures(elements[some], again[owner[some]], weight[some], int(empty.sum()), k, reach * 2)
    return sign


@functools.cache
def _choice() -> np.ndarray:
    return np.array([np.random.default_rng(b).choice(COORDINATES, ROWS, replace=False) for b in range(BANDS)])


def bands(sign: np.ndarray) -> np.ndarray:
    """texts x BANDS hashes, each of the signs at ROWS coordinates and of the band's number."""
    out = np.zeros((len(sign), BANDS), np.uint64)
    for i in range(ROWS):
        out = out * np.uint64(BASE) + sign[:, _choice()[:, i]]
    return mix(out + np.arange(1, BANDS + 1, dtype=np.uint64))


def nodes_of(w: Words, texts: list[str]) -> np.ndarray:
    """A number for each text's words in order; for a text without words, for the text itself."""
    up = np.multiply.accumulate(np.full(int(np.diff(w.cuts()).max(initial=0)) + 1, BASE, np.uint64))
    cuts = w.cuts()
    sizes = np.diff(cuts)
    place = np.arange(len(w.hashes)) - np.repeat(cuts[:-1], sizes)
    term = mix(w.hashes + np.uint64(1)) * up[place]
    run = np.append(np.uint64(0), np.cumsum(term, dtype=np.uint64))
    out = mix(run[cuts[1:]] - run[cuts[:-1]] + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes == 0).tolist():
        out[i] = _sequence(np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)) ^ np.uint64(1)
    return out.view(np.int64)


@settled
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        w = words_of(texts)
        elements, owner, weight = weights(*shingles(w))
        some = np.unique(owner)
        near = np.zeros(len(texts), np.int64)
        near[some] = np.arange(len(some))
        found = bands(signatures(elements, near[owner], weight, len(some)))
        held = np.zeros(len(texts), np.int64)
        held[some] = BANDS
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(found.ravel().view(np.int64)))
        sizes = np.bincount(owner, weight, len(texts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes_of(w, texts)), pa.array(sizes), lists], names=["doc_id", "key", "node", "n", "bands"])


class _Maybe:
    """A bitmap of nodes: what it does not have is not wanted. Its size is bounded (8 MB); it only saves work."""

    def __init__(self, wanted: DataFrame):
        self.shift = shift = 64 - min(26, max(12, math.ceil(math.log2(wanted.count() + 1)) + 5))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = (mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(shift)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["w", "b"])

        got = wanted.select("node").mapInArrow(place, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.table = np.zeros(1 << (64 - shift - 5), np.uint32)
        self.table[got.w.to_numpy().astype(np.int64)] = got.b.to_numpy().astype(np.uint32)

    def has(self, nodes: np.ndarray) -> np.ndarray:
        at = (mix(nodes.view(np.uint64)) >> np.uint64(self.shift)).astype(np.int64)
        return (self.table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): of each wanted node once, its shingles as sorted numbers; a repetition is a number of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(_Maybe(wanted))

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text"):
            nodes = nodes_of(words_of(texts), texts)
            once = np.unique(nodes, return_index=True)[1]
            once = once[shared.value.has(nodes[once])]
            if not len(once):
                continue
            own = [texts[i] for i in once.tolist()]
            elements, owner, weight = weights(*shingles(words_of(own)))
            again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            items, of = mix(np.repeat(elements, weight) + again.astype(np.uint64) * np.uint64(BASE)), np.repeat(owner, weight)
            order = np.lexsort((items, of))
            cuts = np.searchsorted(of, np.arange(len(own) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[once]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(items[order].view(np.int64)))], names=["node", "items"])

    found = docs.select(text_of().alias("text")).mapInArrow(run, "node long, items array<long>")
    return found.groupBy("node").agg(F.first("items").alias("items")).join(wanted, "node", "left_semi")


def link(sets: list[np.ndarray], least: float = LEAST, parts: np.ndarray | None = None, sides: np.ndarray | None = None) -> np.ndarray:
    """The component of each set (its smallest member's number) by all links of similarity ``least`` or more among them.

    ``parts``: numbers of components that are known; sets of one are not compared. ``sides``: where given, sets of one side
    are not compared either. One set after another is compared with all sets of other components at once. Distances obey
    the triangle inequality, so sets too far apart as seen from earlier ones, and sets of too different sizes, need no
    comparison.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    begin = np.append(0, np.cumsum(sizes))
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    root = np.arange(n)
    if parts is not None and n:
        _, first, which = np.unique(parts, return_index=True, return_inverse=True)
        root = first[which]
    seen: list[np.ndarray] = []
    slack = 1 - least + 1e-9
    for i in range(n):
        fine = root != root[i]
        if sides is not None:
            fine &= sides != sides[i]
        fine[:i] = False  # compared from the other side
        if not fine.any():
            if (root == root[i]).all():
                break
            continue
        fine &= np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])
        for far in seen:
            fine &= np.abs(far - far[i]) <= slack
        if len(seen) < 4:  # a vantage point knows all distances
            fine = np.ones(n, bool)
        own = np.flatnonzero(fine)
        if not len(own):
            continue
        counts = sizes[own]
        ids = np.repeat(np.arange(len(own)), counts)
        pieces = flat if len(own) == n else flat[np.arange(counts.sum()) + np.repeat(begin[own] - (np.cumsum(counts) - counts), counts)]
        at = np.minimum(np.searchsorted(sets[i], pieces), max(0, sizes[i] - 1))
        both = np.bincount(ids[sets[i][at] == pieces], minlength=len(own)) if sizes[i] else np.zeros(len(own))
        similar = both / np.maximum(sizes[i] + counts - both, 1)
        if len(seen) < 4:
            seen.append(1 - similar)
        for r in np.unique(root[own[similar >= least]]).tolist():
            low, high = sorted((r, int(root[i])))
            root[root == high] = low
    return root


def _compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    nodes, parts, sides = (group.column(c).to_numpy() for c in ("node", "root", "side"))
    order = np.argsort(nodes)
    items = group.column("items").combine_chunks()
    root = link([items[i].values.to_numpy().view(np.uint64) for i in order.tolist()], LEAST, parts[order], sides[order] if len(set(sides.tolist())) > 1 else None)
    nodes, parts = nodes[order], parts[order]
    first = np.unique(parts, return_index=True)[1]  # one of each component that was known before
    first = first[root[first] != first]
    if group.nbytes > SETTLE_BYTES:
        del items
        settle()
    return pa.table({"a": nodes[root[first]], "b": nodes[first]})


def _stars(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): members that are similar to their leader. One pair of sets per member; JVM functions alone."""
    pairs = members.where("node <> leader AND 5 * least(n, m) >= 4 * greatest(n, m)").select("leader", "node")
    own = pairs.join(sets, "node").withColumnRenamed("items", "own")
    both = own.join(sets.select(F.col("node").alias("leader"), "items"), "leader")
    common = F.size(F.array_intersect("own", "items"))
    return both.where(9 * common >= 4 * (F.size("own") + F.size("items"))).select(F.col("leader").alias("a"), F.col("node").alias("b"))


def _rest(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between members of a group, but for its leader, that lie in different components so far."""
    rest = members.where("node <> leader").join(roots, "node", "left").select("leader", "node", "n", F.coalesce("root", "node").alias("root"))
    parts = rest.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    whole = parts.groupBy("leader").agg(F.max(F.struct("c", "root", "w")).alias("big"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")).where("k > 1")
    tiles = lambda c, w: F.greatest(F.ceil(c / TILE), F.ceil(w * 8 / TILE_BYTES), F.lit(1)).cast("int")
    sized = whole.select("leader", F.col("big.root").alias("most"), tiles(F.col("big.c"), F.col("big.w")).alias("many"), tiles(F.col("c") - F.col("big.c"), F.col("w") - F.col("big.w")).alias("few"))
    sized = cut(sized)
    if sized.count() <= MOST_GROUPS:  # else a join by leader, in which large partitions can be split
        sized = F.broadcast(sized)
    placed = rest.join(sized, "leader").withColumn("side", (F.col("root") != F.col("most")).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node", "leader"), F.when(F.col("side") == 0, F.col("many")).otherwise(F.col("few"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    # a tile of the others meets every tile of the largest part, and every tile of the others
    largest = F.transform(upto("few"), lambda i: at(i, F.col("tile")))
    others = F.concat(F.transform(upto("many"), lambda j: at(F.col("tile"), j)), F.transform(upto("few"), lambda o: at(F.least("tile", o), F.col("many") + F.greatest("tile", o))))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("side") == 0, largest).otherwise(others))).select("leader", "node", "root", "side", "at.i", "at.j")
    return dealt.join(sets, "node").groupBy("leader", "i", "j").applyInArrow(_compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node that has an edge (a, b).

    Large and small stars in turn (neighbours go to the smallest neighbour) until nothing moves.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if before == now:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), class_id per row of ``docs`` (doc_id, text); class_id: the class's smallest doc_id.

    Classes are the components of links: equal words in equal order, or a weighted Jaccard similarity of shingles of
    ``LEAST`` or more. Texts of fewer words than a shingle have one shingle, all their words. Texts without words (empty
    and null ones too) are linked to equal texts alone. Repeated rows give a row each, in one class; a null doc_id never
    names a class unless it has no other. Other columns play no part. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    slim = cut(texts.mapInArrow(_sketches, "doc_id long, key long, node long, n long, bands array<long>"))
    once = slim.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = cut(once.select("node", "n", F.explode("bands").alias("bucket")))
    leaders = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", F.col("first.node").alias("leader"), F.col("first.n").alias("m"))
    members = cut(rows.join(leaders, "bucket").select("leader", "m", "node", "n").distinct())
    sets = cut(_sets(docs, members.select("node").distinct()))
    edges = cut(_stars(members, sets))
    roots = cut(components(edges))
    more = cut(_rest(members, sets, roots))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    # cut, so that the joins stand on plain exchanges, in which a partition with a large class can be split
    roots = cut(roots)
    rooted = cut(slim.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root")))
    names = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")))
    return rooted.join(names, "root").select("doc_id", "key", "class_id", ((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("key") == F.col("first.key"))).alias("is_first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand first in their class (smallest doc_id, then hash of the text), each once, all columns.

    Of rows equal in doc_id and text, that of the smallest hash of all columns stays, whatever their order. Nulls, empty
    texts and empty tables are as in :func:`classes`; columns of any name stay as they are.
    """
    one, key, text, rest = fresh(docs.columns, "one", "key", "text_key", "rest")
    first = classes(docs).where("is_first").select(F.col("doc_id").alias(one), F.col("key").alias(key)).distinct()
    rows = docs.withColumn(text, F.xxhash64(text_of()))
    kept = rows.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(text) == F.col(key)), "left_semi")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return kept.groupBy(F.col("doc_id").alias(one), text).agg(F.min_by(F.struct(*names), order).alias(rest)).select(f"{rest}.*")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "is_first")

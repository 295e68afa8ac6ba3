"""Quality by an interpolated modified Kneser-Ney model over characters, trained on trusted text.

Texts are dealt into blocks by a hash of doc_id and text and packed before they are shuffled, labels along with them; the
blocks are written once. Each block gives the n-grams it holds once, with their counts in trusted text; counts, contexts and probabilities are sharded
tables joined on n-grams; each block gets back the probabilities of its own n-grams and scores its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, dealt, fresh, settle, settled, table, text_of

ORDER = 4
#: Code points of a block, about, and tasks that blocks are dealt to at most. Blocks follow from the size of all texts.
BLOCK_CHARS, MOST_TASKS = 6_000_000, 8192
#: Stand before and behind every text (private use). Fixed values.
BEFORE, BEHIND = "\ue000", "\ue001"
#: One in so many distinct trusted texts isn't trained on; upper thresholds are quantiles of these.
HELD_BACK = 5
#: Quantiles of surprise among trusted (LOW) and held-back trusted (HIGH) texts of a language, how much farther out the thresholds lie, and
#: how many held-back texts a language needs to be judged; all documents of the others are kept.
LOW, HIGH, FARTHER, LEAST_DOCS = 0.002, 0.995, 1.15, 30
#: Characters beyond which a longer text's mean is not taken to be more certain.
STEADY = 4000
#: Languages of which the thresholds are broadcast.
MOST_LANGUAGES = 10_000


def _steps(n: int) -> Iterator[slice]:
    """Stretches of n positions: numpy makes 8-byte indices of those it is given, here of a stretch at a time."""
    return (slice(i, i + (1 << 20)) for i in range(0, n, 1 << 20))


def _dense(first: np.ndarray, n: int, second: np.ndarray, m: int) -> tuple[np.ndarray, int]:
    """Numbers without gaps for pairs of numbers below n and m."""
    if n * m <= 1 << 24:
        keys = np.multiply(first, np.int32(m), dtype=np.int32)
        keys += second
        there = np.zeros(n * m, bool)
        for s in _steps(len(keys)):
            there[keys[s]] = True
        found = np.flatnonzero(there)
        rank = np.empty(n * m, np.int32)
        rank[found] = np.arange(len(found), dtype=np.int32)
        for s in _steps(len(keys)):
            keys[s] = rank[keys[s]]
        return keys, len(found)
    found, number = np.unique(first.astype(np.int64) * m + second, return_inverse=True)
    return number.astype(np.int32), len(found)


class Grams:
    """The n-grams of several texts: a number for each position, and the n-gram of each number."""

    def __init__(self, texts: list[str], order: int = ORDER):
        pad = BEFORE * (order - 1)
        joined = "".join(f"{pad}{t}{BEHIND}" for t in texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        there = np.zeros(0x110000, bool)
        for s in _steps(len(cp)):
            there[cp[s]] = True
        letters = np.flatnonzero(there)
        rank = np.zeros(0x110000, np.uint16 if len(letters) <= 1 << 16 else np.int32)
        rank[letters] = np.arange(len(letters))
        single = np.empty(len(cp), rank.dtype)
        for s in _steps(len(cp)):
            single[s] = rank[cp[s]]
        del cp, there, rank
        ids, n = single, len(letters)
        for i in range(1, order):
            ids, n = _dense(ids[: len(ids) - 1], n, single[i:], len(letters))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.append(0, np.cumsum(sizes + order - 1))
        inside = np.ones(len(ids), bool)
        for i in range(1, order):  # windows that would run into the next text
            at = starts[1:-1] - i
            inside[at] = False
        at = np.full(n, -1, np.int64)
        for s in _steps(len(ids)):  # a place where each stands
            own = np.flatnonzero(inside[s]) + s.start
            at[ids[own]] = own
        self.sizes, self.ids = sizes, ids[inside]
        del ids, inside, single
        self.numbers = np.flatnonzero(at >= 0)
        self.names = [joined[a : a + order] for a in at[self.numbers].tolist()]
        self.n = n

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """How often each n-gram in ``names`` occurs in the texts flagged."""
        return np.bincount(self.ids[np.repeat(texts, self.sizes)], minlength=self.n)[self.numbers]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of the values (one for each of ``names``) over its positions."""
        full = np.zeros(self.n)
        full[self.numbers] = values
        if not len(self.sizes):
            return np.zeros(0)
        cuts, out = np.append(0, np.cumsum(self.sizes)), np.zeros(len(self.sizes))
        for i in range(0, len(out), 256):
            a, b = cuts[i], cuts[min(i + 256, len(out))]
            out[i : i + 256] = np.add.reduceat(full[self.ids[a:b]], cuts[i : min(i + 256, len(out))] - a)
        return out


def _apart(batch: pa.RecordBatch, of: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of the rows of a batch: the first row of a doc_id and text goes where its label goes, its repetitions, which
    never are the one row that speaks for a text, anywhere; so no block collects all rows of one id and text."""
    ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(0).to_numpy(zero_copy_only=False)
    keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
    order = np.lexsort((ids, keys))
    again = np.append(False, (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1]))
    of = of.copy()
    of[order[again]] = (of[order[again]] + 1 + np.arange(int(again.sum()))) % blocks
    return of


def _packed(df: DataFrame, kind: int, blocks: int) -> DataFrame:
    """(block, kind, payload): rows of a batch that share __block, as a compressed Arrow stream."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy()
            if kind == 0 and len(of):
                of = _apart(batch, of, blocks)
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(of) else []
            rows = batch.select(range(1, batch.num_columns))
            for at in np.split(order, cuts[1:]) if len(of) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array([of[at[0]]], pa.int64()), pa.array([kind], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "kind", "payload"])

    return df.mapInArrow(run, "block long, kind long, payload binary")


def _unpack(group: pa.Table) -> tuple[pa.Table | None, list[str], np.ndarray]:
    """Documents of a block, their texts, and which of them speak for a distinct trusted text (see _once), one row each."""
    kinds, payloads = group.column("kind").to_pylist(), group.column("payload").to_pylist()
    read = lambda kind: [pa.ipc.open_stream(p).read_all() for k, p in zip(kinds, payloads, strict=True) if k == kind]
    docs, labels = read(0), read(1)
    if not docs:
        return None, [], np.zeros(0, bool)
    docs = pa.concat_tables(docs)
    left = {pair for t in labels for pair in zip(t.column("doc_id").to_pylist(), t.column("key").to_pylist(), strict=True)}
    trusted = np.zeros(docs.num_rows, bool)
    for i, pair in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("key").to_pylist(), strict=True)):
        if pair in left:
            left.remove(pair)
            trusted[i] = True
    return docs.drop_columns(["text"]), docs.column("text").to_pylist(), trusted


def _once(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, key): of each distinct trusted text the smallest doc_id, lest copies teach the model that text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"))
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id"))
    return cut(rows.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "key"))


def _blocks(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    size = docs.agg(F.sum(F.length(text_of()).cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks)).alias("__block")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("lang"), _key().alias("key"), text_of().alias("text"))
    both = _packed(texts.select(block, "*"), 0, blocks).unionByName(_packed(_once(docs, trusted).select(block, "*"), 1, blocks))
    # written as dealt: both passes over the blocks find them in place, without another shuffle
    return dealt(both, min(blocks, MOST_TASKS), "block")


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _key() -> Column:
    return F.xxhash64(text_of())


def _held_back(docs: pa.Table) -> np.ndarray:
    keys = docs.column("key").to_numpy().astype(np.uint64)
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % HELD_BACK == 0


def _gram_counts(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    docs, texts, trusted = _unpack(group)
    if docs is None:
        return pa.table({"block": pa.array([], pa.int64()), "gram": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    grams = Grams(texts)
    del texts
    n = grams.counts(trusted & ~_held_back(docs))
    settle()
    return pa.table({"block": pa.array(np.full(len(n), key[0].as_py()), pa.int64()), "gram": pa.array(grams.names, pa.string()), "n": pa.array(n, pa.int64())})


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams seen one to four times."""
    n = [0] * 5
    for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r.c] = r.n
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
    return [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(raw, 1)]


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) for every n-gram in ``asked``: interpolated modified Kneser-Ney from ``counts`` (gram, c > 0).

    Orders below the highest count the different characters before an n-gram. A context never seen leaves all to the
    next lower order; the lowest is interpolated with the uniform distribution over seen characters and one unseen.
    """
    right = lambda k: F.substring("gram", F.lit(2), F.lit(k))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].select(right(k).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    wanted = {order: asked.select("gram").distinct()}
    for k in range(order - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(right(k).alias("gram")).distinct()
    lower = None
    for k in range(1, order + 1):
        d = _discounts(tables[k])
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        about = tables[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(less).alias("spared"), F.count(F.lit(1)).alias("kinds"))
        here = wanted[k].join(tables[k], "gram", "left").withColumn("context", context)
        own = F.when(F.col("c").isNull(), 0.0).otherwise((F.col("c") - less) / F.col("total"))
        if k == 1:
            seen = about.first()
            total, spared, kinds = (seen.total, seen.spared, seen.kinds) if seen else (1, 1.0, 0)
            p = F.coalesce((F.col("c") - less) / F.lit(float(total)), F.lit(0.0)) + spared / total / (kinds + 1)
            lower = here.select("gram", p.alias("p"))
            continue
        here = here.join(about, "context", "left").join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), F.substring("gram", F.lit(2), F.lit(k - 1)) == F.col("suffix"), "left")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(own + F.col("spared") / F.col("total") * F.col("below"))
        lower = here.select("gram", p.alias("p"))
    return lower.select("gram", F.log("p").cast("float").alias("logp"))


SCORED = "doc_id long, key long, lang string, trusted boolean, held_back boolean, n long, bits double"


def _score_block(key: tuple[pa.Scalar, ...], group: pa.Table, known: pa.Table) -> pa.Table:
    docs, texts, trusted = _unpack(group)
    if docs is None:
        return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(SCORED.split(", "), (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.float64()), strict=True)})
    grams = Grams(texts)
    logs = dict(zip(known.column("gram").to_pylist(), known.column("logp").to_pylist(), strict=True))
    sums = grams.sums(np.fromiter(map(logs.__getitem__, grams.names), np.float64, len(grams.names)))
    bits = -sums / grams.sizes / math.log(2)
    del texts, grams.ids, logs
    settle()
    return pa.table({"doc_id": docs.column("doc_id"), "key": docs.column("key"), "lang": docs.column("lang"), "trusted": pa.array(trusted), "held_back": pa.array(trusted & _held_back(docs)), "n": pa.array(grams.sizes, pa.int64()), "bits": pa.array(bits)})


def _quantiles(rows: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles per lang of ``value``, to a hundredth, from counts per language and value."""
    counts = rows.groupBy("lang", F.round(value, 2).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    rising = Window.partitionBy("lang").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("lang", "v", F.sum("k").over(rising).alias("upto"), F.sum("k").over(Window.partitionBy("lang")).alias("docs"))
    at = [F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("v"))).alias(name) for name, q in wanted.items()]
    return ranked.groupBy("lang").agg(F.max("docs").alias("docs"), *at)


def _for_language(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the language's values, null where it has fewer than ``LEAST_DOCS`` held-back texts: another
    language's values would say nothing of it."""
    own = cut(found.where(F.col("docs") >= LEAST_DOCS).select("lang", *names))
    if own.count() <= MOST_LANGUAGES:  # else a join by language, in which large partitions can be split
        own = F.broadcast(own)
    return rows.join(own, "lang", "left")


def judge(scored: DataFrame) -> DataFrame:
    """``scored`` with surprise and keep. Surprise: bits beyond the language's median, times the root of the length,
    so that short texts, whose means vary more, are not judged by the measure of long ones. The lower threshold lies as
    far out as the upper one at least, and counts the texts trained on too, of which the model knows more than of those
    held back: text that the model knows well is not junk for that."""
    rows = _for_language(scored, _quantiles(scored.where("held_back"), "bits", {"median": 0.5}), ["median"])
    rows = rows.withColumn("surprise", (F.col("bits") - F.col("median")) * F.sqrt(F.least("n", F.lit(STEADY))))
    low = _quantiles(rows.where("trusted"), "surprise", {"low": LOW}).drop("docs")
    rows = _for_language(rows, _quantiles(rows.where("held_back"), "surprise", {"high": HIGH}).join(low, "lang"), ["low", "high"])
    inside = (F.col("surprise") >= F.least("low", -F.col("high")) * FARTHER) & (F.col("surprise") <= F.col("high") * FARTHER)
    return rows.withColumn("keep", F.col("high").isNull() | F.coalesce(inside, F.lit(True)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, key (hash of the text), lang, n, bits, surprise, keep.

    bits: bits per character, the text's end counted as one; perplexity is 2 ** bits. keep: whether surprise lies within
    quantiles of the language's trusted documents (above: junk; below: repetition). However many copies a trusted text
    has, the model and the quantiles count it once. Empty texts are
    scored on their end alone. Null text reads as empty, null lang as the language ''. Without trusted documents bits
    is null and all are kept. Of a language with fewer than LEAST_DOCS held-back trusted texts (about 150 trusted ones) all
    are kept, junk too, and surprise is null. Repeated rows get a row each.
    """
    trusted = labels.where("quality = 1").select("doc_id")
    blocks = _blocks(docs, trusted)
    grams = cut(blocks.groupBy("block").applyInArrow(_gram_counts, "block long, gram string, n long"))
    summed = cut(grams.groupBy("gram").agg(F.sum("n").alias("c")))
    counts = summed.where("c > 0")
    if counts.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), _language().alias("lang"), (F.length(text_of()) + 1).cast("long").alias("n"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("surprise"), F.lit(True).alias("keep"))
    logs = grams.select("block", "gram").join(probabilities(counts, summed), "gram").select("block", "gram", "logp")
    scored = cut(blocks.groupBy("block").cogroup(logs.groupBy("block")).applyInArrow(_score_block, SCORED))
    return judge(scored).select("doc_id", "key", "lang", "n", "bits", "surprise", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, all their columns. Rows alike in doc_id and text share a verdict;
    columns of any name stay as they are."""
    one, key, text = fresh(docs.columns, "one", "key", "text_key")
    bad = score(docs, labels).where("NOT keep").select(F.col("doc_id").alias(one), F.col("key").alias(key)).distinct()
    rows = docs.withColumn(text, _key())
    return rows.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(text) == F.col(key)), "left_anti").drop(text)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per character, perplexity and verdict of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = score(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return done.select("doc_id", "lang", "n", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "surprise", "keep")

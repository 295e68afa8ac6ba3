"""Toxicity by boosted trees over dense features of whole texts, calibrated isotonically."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic, fit, isotonic, sigmoid
from .common import chunks, cut, fresh, settled, table, text_of
from .words import KNOWN, Words, word_table, words_of

#: Insults of four languages, in lower case, and words that address the reader. Fixed values.
INSULTS = (
    "asshole bastard bitch clown coward crap creep cretin damn disgusting dumb dumbass filth fool freak garbage idiot imbecile jerk "
    "loser lunatic moron nasty pathetic pig psycho rat retard scum scumbag shit slut stupid swine trash ugly vermin vile weirdo whore worthless "
    "abschaum arschloch blödmann depp dreckskerl dummkopf idioten miststück schwein trottel versager wichser "
    "abruti connard connasse crétin débile enfoiré imbécile merde minable ordure salaud salope "
    "basura cabrón capullo estúpido estúpida gilipollas imbécil inútil mierda pendejo puta tonto"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem ihr euch euer "
    "tu te toi ton tes vous votre vos tú ti tus usted ustedes vosotros vuestro"
).split()
#: What stands for a letter in disguised words. Fixed values.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
#: Labelled rows that a model is fitted on at most (those of smallest hash of doc_id), lengths of stems, and stems kept.
MOST_ROWS, STEMS, MOST_STEMS = 20_000, (4, 5, 6, 7, 8), 4_000
#: Bytes of text of which stems are counted at a time: each word has as many as there are lengths.
STEM_BYTES = 300_000
#: Toxic training rows that a stem must occur in, and how many times as frequent it must be among them.
LEAST_ROWS, LEAST_RATIO = 4, 6.0
#: Score from which a document counts as toxic.
TOXIC_FROM = 0.7


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(words_of(words).hashes) if words else np.empty(0, np.uint64)


class Lexicon:
    """Weights of hashed words or stems; a bitmap spares most searches."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order].astype(np.uint64), weights[order].astype(float)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that the lexicon has, and their weights."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0)
        found = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[found] == hashes[at]
        return at[hit], self.weights[found[hit]]


def stem_hashes(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and hashes: of each stem length, and of whole words of other lengths."""
    for n in STEMS:
        yield words.prefixes(n)
    size = words.ends - words.starts
    rest = np.flatnonzero((size < STEMS[0]) | (size > STEMS[-1]))
    yield rest, words.hashes[rest]


_BASE = Lexicon(_hashes(INSULTS), np.ones(len(_hashes(INSULTS))))
_YOU = Lexicon(_hashes(SECOND_PERSON), np.ones(len(_hashes(SECOND_PERSON))))


def features(texts: list[str], learned: Lexicon) -> np.ndarray:
    """One row per text: lexicon densities, nearness to the second person, capitals, punctuation, disguise."""
    w = words_of(texts)
    n = len(texts)
    per = lambda at, weight=None: np.bincount(at, weight, n).astype(float)
    evidence = np.zeros(len(w.hashes))
    for number, hashes in stem_hashes(w):
        at, weight = learned.of(hashes)
        np.maximum.at(evidence, number[at], weight)
    insult = np.zeros(len(w.hashes), bool)
    insult[_BASE.of(w.hashes)[0]] = True
    you = _YOU.of(w.hashes)[0]

    cp = w.codes
    text = np.repeat(np.arange(n), np.diff(np.append(w.offsets, len(cp))))
    low = word_table()[np.minimum(cp, KNOWN - 1)]
    letter = low > 0
    capital = letter & (low != cp)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0)
    mark = ~letter & ~blank
    inside = np.zeros(len(cp), bool)
    inside[1:-1] = letter[:-2] & letter[2:] & (mark[1:-1] | ((cp[1:-1] >= 48) & (cp[1:-1] <= 57)))
    inside &= cp != 0x27
    disguised = np.zeros(n)
    spots = np.flatnonzero(inside)
    if len(spots):
        tokens, owners = _tokens_around(spots, cp, blank, text)
        plain = words_of([t.lower().translate(DISGUISE) for t in tokens])
        hit = np.union1d(_BASE.of(plain.hashes)[0], learned.of(plain.hashes)[0]).astype(np.int64)
        disguised = per(owners[np.unique(plain.owner[hit])])
    triple = np.zeros(len(cp), bool)
    triple[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])

    hits = np.flatnonzero(insult | (evidence > 0))
    near = np.full(len(hits), 99.0)
    if len(you):
        at = np.searchsorted(you, hits)
        for side in (np.minimum(at, len(you) - 1), np.maximum(at - 1, 0)):
            same = w.owner[you[side]] == w.owner[hits]
            near = np.where(same, np.minimum(near, np.abs(you[side] - hits)), near)
    top = np.zeros(n)
    np.maximum.at(top, w.owner, evidence)
    words, chars = per(w.owner), per(text[letter]) + 1
    size = per(text) + 1
    found = per(w.owner[hits])
    return np.column_stack([
        per(w.owner[insult]), per(w.owner[insult]) / (words + 1) * 100, found, found / (words + 1) * 100,
        per(w.owner, evidence), per(w.owner, evidence) / (words + 1) * 100, top, disguised,
        per(w.owner[hits], np.exp(-near / 5)), per(w.owner[you]) / (words + 1) * 100,
        per(text[capital]) / chars, per(text[mark]) / size, per(text[cp == 33]) / size, per(text[cp == 63]) / size,
        per(text[inside]) / size * 100, per(text[triple]) / size * 100, np.log1p(words), chars / (words + 1),
    ])


def _tokens_around(spots: np.ndarray, cp: np.ndarray, blank: np.ndarray, text: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The tokens between blanks that hold the spots, each once."""
    gaps = np.append(np.insert(np.flatnonzero(blank), 0, -1), len(cp))
    at = np.unique(np.searchsorted(gaps, spots) - 1)
    starts, ends = gaps[at] + 1, gaps[at + 1]
    whole = cp.tobytes().decode("utf-32-le", "replace")
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], text[starts]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    curve: Isotonic | None
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(features(texts, self.lexicon))
        return np.clip(0.999 * self.curve(margin) + 0.001 * sigmoid(margin), 0.0, 1.0)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _stem_counts(df: DataFrame) -> DataFrame:
    """Rows (stem, n00, n01, n10, n11): in how many texts of each fold and label a stem occurs."""
    of = lambda fold, label: F.coalesce(F.sum(F.when((F.col("fold") == fold) & (F.col("toxic") == label), F.col("n"))), F.lit(0)).alias(f"n{fold}{label}")

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", STEM_BYTES):
            w = words_of(texts)
            kind = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            found, owner = [], []
            for number, hashes in stem_hashes(w):
                found.append(hashes), owner.append(w.owner[number])
            h, o = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            once = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.empty(0, bool)
            h, k = h[once], kind[o[once]]
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))) if len(h) else np.empty(0, int)
            n = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(k[first] // 2, pa.int64()), pa.array(k[first] % 2, pa.int64()), pa.array(h[first].view(np.int64)), pa.array(n, pa.int64())], names=["fold", "toxic", "stem", "n"])

    return df.select("fold", "toxic", "text").mapInArrow(run, "fold long, toxic long, stem long, n long").groupBy("stem").agg(*[of(f, t) for f in (0, 1) for t in (0, 1)])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit lexicon, trees and calibration on at most ``most_rows`` labelled rows outside the held-out third.

    Stems are learned on each half of these rows and applied to the other, so that features of training rows do not
    know their own labels; the calibration uses margins of trees that have not seen the row. Without rows of both labels
    the score is the share of label 1 (0 without rows). Of a doc_id that occurs more than once, in ``labels`` or ``docs``,
    one row counts: toxic if any label says so, with the text of the smallest hash. Null doc_ids and labels take no part.
    Columns beyond doc_id, text and toxic play none either.
    """
    spark = docs.sparkSession
    sample = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("long")).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)))
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")  # MOST_ROWS rows
    texts = cut(found.groupBy("doc_id", "fold", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("fold", "toxic", "text"))
    shares = {(r.fold, r.toxic): r.n for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, toxic = sum(shares.values()), sum(n for k, n in shares.items() if k[1])
    empty = Lexicon(np.empty(0, np.uint64), np.empty(0))
    if min((shares.get((f, t), 0) for f in (0, 1) for t in (0, 1)), default=0) < 2:
        return Model(empty, None, None, toxic / rows if rows else 0.0)
    counts = cut(_stem_counts(texts).where(F.col("n01") + F.col("n11") >= LEAST_ROWS))

    def lexicon(fold: int | None) -> Lexicon:
        """Stems of the largest ratio, of the rows of one half or of all."""
        folds = (0, 1) if fold is None else (fold,)
        seen = {t: sum((F.col(f"n{f}{t}") for f in folds), F.lit(0)) for t in (0, 1)}
        n = {t: sum(shares[f, t] for f in folds) for t in (0, 1)}
        ratio = (seen[1] + 0.5) / (n[1] + 1) / ((seen[0] + 0.5) / (n[0] + 1))
        least = LEAST_ROWS if fold is None else max(2, LEAST_ROWS // 2)
        best = counts.select("stem", seen[1].alias("rows"), ratio.alias("ratio")).where((F.col("rows") >= least) & (F.col("ratio") >= LEAST_RATIO))
        top = best.orderBy(F.desc("ratio"), "stem").limit(MOST_STEMS).toPandas()
        return Lexicon(top.stem.to_numpy().astype(np.int64).view(np.uint64), np.log(top.ratio.to_numpy(float)))

    whole, halves = lexicon(None), {f: lexicon(1 - f) for f in (0, 1)}
    width = features(["a"], whole).shape[1]

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches, "text"):
            fold = batch.column(0).to_numpy()
            x = np.zeros((len(chunk), width))
            for f in (0, 1):
                own = np.flatnonzero(fold == f)
                if len(own):
                    x[own] = features([chunk[i] for i in own], halves[f])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], names=["fold", "toxic", "x"])

    got = texts.select("fold", "toxic", "text").mapInArrow(run, "fold long, toxic long, x array<double>").toPandas()
    x, y, fold = np.array(got.x.tolist()), got.toxic.to_numpy(float), got.fold.to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    margins = np.zeros(len(y))
    for f in (0, 1):
        margins[fold == f] = fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(whole, fit(x, y), isotonic(margins, y), float(y.mean()))


def score(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """All rows and columns of ``docs`` and a score under ``name``, which must be free. Null and empty texts have a score
    too, repeated rows one each; an empty table gives no rows."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name!r} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MOST_STEMS weights and the trees
    names = docs.columns
    schema = docs.withColumn(name, F.lit(0.0)).schema

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts))], names=[*names, name])

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below ``TOXIC_FROM``, all their columns, by a model fitted on labelled rows of ``docs``.

    Columns of any name stay as they are. Without labelled rows of both kinds nothing tells documents apart, and all stay.
    """
    (name,) = fresh(docs.columns, "score")
    model = train(docs, labels)
    return docs if model.trees is None else score(docs, model, name).where(F.col(name) < TOXIC_FROM).drop(name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated score of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    done = score(docs, model).select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"))
    return done.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))

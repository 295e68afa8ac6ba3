"""Models, pages, archives and vectors: against brute force, on awkward rows."""

import base64
import collections
import hashlib
import math
import random
import time
import uuid

import numpy as np
import pytest

from tidemark.llm import ann, boosting, html, quality, toxicity, warc
from tidemark.llm.common import shared_dir


def test_boosting_learns_a_product_and_isotonic_rises():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    margin = model.margin(x[2000:])
    assert ((margin > 0) == (y[2000:] > 0)).mean() > 0.93
    curve = boosting.isotonic(margin, y[2000:])
    assert (np.diff(curve.value) > 0).all() and abs(curve(margin).mean() - y[2000:].mean()) < 0.02
    assert boosting.isotonic(np.zeros(3), np.array([0.0, 1, 1])).value.tolist() == pytest.approx([2 / 3])


def documents(r, n):
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tree", "house", "river"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        if i % 5 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "st*pid", "blorgish", "you moron"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_scores_held_out_rows_and_awkward_ones(spark):
    rows, labels = documents(random.Random(1), 900)
    extra = [(None, None), (5000, ""), (5001, "x" * 20_000), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, "z") for x in rows + extra], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    done = toxicity.score(docs, model)
    assert done.columns == [*docs.columns, "__score"]
    got = done.select("doc_id", "__score", toxicity.held_out().alias("out")).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= x["__score"] <= 1 for x in got)
    truth = dict(labels)
    out = [x for x in got if x.out and x.doc_id is not None and x.doc_id < 900]
    assert sum((x["__score"] >= 0.7) == truth[x.doc_id] for x in out) > 0.97 * len(out) > 200
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(5), none).select("__score").distinct().collect()[0][0] == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_with_repeated_ids_and_taken_names(spark):
    rows, labels = documents(random.Random(2), 300)
    docs = spark.createDataFrame([(*x, "z", 1.0) for x in rows + [rows[0]] * 50 + [(rows[1][0], "another text")]], "doc_id long, text string, score string, __score double")
    labels = spark.createDataFrame(labels * 2 + [(3, 1), (None, 1)], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 200 < kept.count() < 300 + 50
    with pytest.raises(ValueError, match="__score"):
        toxicity.score(docs, toxicity.train(docs, labels))
    few = toxicity.train(docs, labels, most_rows=40)
    assert few.trees is None or few.prior < 1


def naive_isotonic(margin, y):
    """Pools of adjacent violators, one after another, in plain Python: sum of margins, the last one, sum of y, rows."""
    pools = []
    for m in sorted(set(margin)):
        own = [b for a, b in zip(margin, y, strict=True) if a == m]
        pools.append([m * len(own), m, sum(own), len(own)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return pools


def test_isotonic_equals_pooling():
    r = random.Random(3)
    for n in (1, 5, 200):
        margin = [round(r.gauss(0, 1), 1) for _ in range(n)]
        y = [float(r.random() < 1 / (1 + math.exp(-m))) for m in margin]
        curve = boosting.isotonic(np.array(margin), np.array(y))
        pools = naive_isotonic(margin, y)
        assert curve.value.tolist() == pytest.approx([s / k for _, _, s, k in pools])
        assert [curve(np.array([a / k]))[0] for a, _, _, k in pools] == pytest.approx([s / k for _, _, s, k in pools])


def test_first_split_equals_trying_all():
    r = np.random.default_rng(4)
    x = r.integers(0, 9, (120, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (r.random(120) < 0.1)).astype(float)
    model = boosting.fit(x, y)
    p = y.mean()
    best = max((((y[x[:, f] <= t] - p).sum() ** 2 / (len(y[x[:, f] <= t]) * p * (1 - p) + 1) + (y[x[:, f] > t] - p).sum() ** 2 / (len(y[x[:, f] > t]) * p * (1 - p) + 1), f) for f in range(3) for t in range(8)))
    assert best[1] == 1 and ((model.margin(x) > 0) == (x[:, 1] > 4)).mean() > 0.95


def kneser_ney(counts, order):
    """Probabilities as the books give them, by recursion over plain dictionaries."""
    tables = {order: collections.Counter(counts)}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discounts = {}
    for k, t in tables.items():
        n = [0] + [sum(c == i for c in t.values()) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        discounts[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        d = lambda c: discounts[k][min(c, 3) - 1]
        around = {g: c for g, c in tables[k].items() if g[:-1] == gram[:-1]}
        below = p(gram[1:]) if k > 1 else 1 / (len(tables[1]) + 1)
        if not around:
            return below
        total = sum(around.values())
        own = tables[k].get(gram, 0)
        return (own - d(own) if own else 0) / total + sum(map(d, around.values())) / total * below

    return p


def test_probabilities_equal_the_recursion(spark):
    r = random.Random(2)
    text = "".join(r.choice("aabbc ") for _ in range(400))
    counts = collections.Counter(text[i : i + 3] for i in range(len(text) - 2))
    asked = [*counts, "zab", "abz", "zzz", "cca"]
    p = kneser_ney(counts, 3)
    table = spark.createDataFrame(list(counts.items()), "gram string, c long")
    got = {x.gram: x.logp for x in quality.probabilities(table, spark.createDataFrame([(a,) for a in asked], "gram string"), 3).collect()}
    assert got.keys() == set(asked)
    assert all(math.exp(got[a]) == pytest.approx(p(a), rel=1e-5) for a in asked)
    assert sum(p("ab" + c) for c in {*text}) + p("ab?") == pytest.approx(1.0)


def test_grams_of_texts():
    texts = ["abcab", "", "zz"]
    grams = quality.Grams(texts, 3)
    want = [collections.Counter(f"{t}"[i : i + 3] for i in range(len(t) + 1)) for t in texts]
    assert dict(zip(grams.names, grams.counts(np.array([True, False, True])).tolist(), strict=True)) == {g: (want[0] + want[2])[g] for g in set(want[0]) | set(want[1]) | set(want[2])}
    value = {g: float(i + 1) for i, g in enumerate(grams.names)}
    assert grams.sums(np.array([value[g] for g in grams.names])).tolist() == [sum(value[g] * n for g, n in w.items()) for w in want]


def test_quality_keeps_prose_and_drops_junk(spark):
    r = random.Random(3)
    words = ["stone", "water", "green", "garden", "morning", "letter", "window", "silver"]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)), "en") for i in range(300)]
    junk = [(1000 + i, "".join(r.choice("#$%&QXZ0123|") for _ in range(200)), "en") for i in range(10)]
    odd = [(2000, None, None), (2001, "", "en"), (None, rows[0][1], "en"), (3, rows[3][1], "en")]
    docs = spark.createDataFrame([(*x, 1, "k", 2.0, 3) for x in rows + junk + odd], "doc_id long, text string, lang string, n int, key string, bits double, block int")
    labels = spark.createDataFrame([(i, 1) for i in range(250)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    ids = [x.doc_id for x in kept.collect()]
    assert kept.columns == docs.columns and not [i for i in ids if i and 1000 <= i < 1010] and sum(i is not None and i < 300 for i in ids) >= 297
    scored = quality.score(docs, labels.limit(0))
    assert scored.count() == docs.count() and scored.where("NOT keep").count() == 0
    assert quality.score(docs.limit(0), labels).count() == 0


def test_quality_deals_repeated_rows_apart_and_keeps_names(spark, monkeypatch):
    r = random.Random(6)
    words = ["stone", "water", "green", "garden", "morning", "letter", "window", "silver"]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)), "en") for i in range(200)]
    rows.append((300, " ".join(r.choice(words) for _ in range(4000)), "en"))  # longer than a block below
    hot = [(None, rows[0][1], "en")] * 500 + [(7, rows[7][1], "en")] * 500 + [(None, None, "en")] * 100
    docs = spark.createDataFrame([(*x, "k", 1, "l") for x in rows + hot], "doc_id long, text string, lang string, __text string, one long, key string").coalesce(1)
    labels = spark.createDataFrame([(i, 1) for i in range(180)], "doc_id long, quality int")
    whole = {(x.doc_id, x.key): x.bits for x in quality.score(docs, labels).collect()}
    monkeypatch.setattr(quality, "BLOCK_CHARS", 2000)
    blocks = quality._blocks(docs, labels.select("doc_id"))
    assert max(x["count"] for x in blocks.where("kind = 0").groupBy("block").count().collect()) < 20
    done = quality.score(docs, labels).collect()
    assert len(done) == len(rows) + len(hot) and all(x.bits == pytest.approx(whole[x.doc_id, x.key], rel=1e-5) for x in done)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    # the blocks are found where they were written
    plan = blocks.groupBy("block").applyInArrow(quality._gram_counts, "block long, gram string, n long")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def naive_quantile(values, q):
    values = sorted(round(v, 2) for v in values)
    return next(v for i, v in enumerate(values, 1) if i >= q * len(values))


def test_verdicts_equal_plain_arithmetic(spark):
    r = random.Random(7)
    rows = []
    for i in range(600):
        lang = "en" if i < 400 else "de" if i < 580 else "xx"
        trusted = i % 2 == 0
        rows.append((i, i, lang, trusted, trusted and i % 4 == 0, r.randint(1, 9000), round(r.gauss(3, 0.2) + (4 if i % 50 == 49 else 0), 4)))
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, quality.SCORED)).collect()}
    for lang in ("en", "de", "xx"):
        own = [x for x in rows if x[2] == lang]
        held = [x for x in own if x[4]]
        if len(held) < quality.LEAST_DOCS:
            assert all(got[x[0]].keep and got[x[0]].surprise is None for x in own)
            continue
        median = naive_quantile([x[6] for x in held], 0.5)
        surprise = {x[0]: (x[6] - median) * math.sqrt(min(x[5], quality.STEADY)) for x in own}
        high = naive_quantile([surprise[x[0]] for x in held], quality.HIGH)
        low = min(naive_quantile([surprise[x[0]] for x in own if x[3]], quality.LOW), -high)
        for x in own:
            assert got[x[0]].surprise == pytest.approx(surprise[x[0]])
            assert got[x[0]].keep == (low * quality.FARTHER <= surprise[x[0]] <= high * quality.FARTHER)


def lexicon(r, n, letters):
    return ["".join(r.choice(letters) for _ in range(6)) for _ in range(n)]


def test_quality_keeps_a_trusted_text_with_many_copies(spark):
    r = random.Random(4)
    words = lexicon(r, 300, "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, " ".join(r.choice(words) for _ in range(100)), "en") for i in range(400)]
    for n in range(2):
        rows += [(10_000 * (n + 1) + i, rows[n][1], "en") for i in range(100)]
    rows += [(n, rows[n][1], "en") for n in range(2) for _ in range(3)]
    junk = [(90_000 + i, "".join(r.choice("#$%&QXZ0123|") for _ in range(400)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in sorted({i for i, _, _ in rows})] + [(3, 1)], "doc_id long, quality int")
    done = quality.score(docs, labels).collect()
    assert len(done) == len(rows) + len(junk)
    bad = {x.doc_id for x in done if not x.keep}
    assert not [i for i in bad if 10_000 <= i < 90_000 or i < 2] and {i for i, *_ in junk} <= bad
    alone = {x.key: x.bits for x in quality.score(docs.where("doc_id < 10000 or doc_id >= 90000").distinct(), labels).collect()}
    assert all(x.bits == pytest.approx(alone[x.key], rel=1e-5) for x in done)


def test_quality_keeps_languages_with_little_trusted_text(spark):
    r = random.Random(5)
    known, other = lexicon(r, 60, "abcdefghijklmnop"), lexicon(r, 60, "мнопрстуфхцчшщ")
    text = lambda words: " ".join(r.choice(words) for _ in range(60))
    rows = [(i, text(known), "en") for i in range(250)] + [(1000 + i, text(other), "ru") for i in range(60)] + [(2000 + i, text(other), "uk") for i in range(20)]
    junk = [(90_000 + i, "".join(r.choice("#$%&QXZ0123|") for _ in range(400)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(250)] + [(1000 + i, 1) for i in range(8)], "doc_id long, quality int")
    kept = {x.doc_id for x in quality.keep_good(docs, labels).collect()}
    assert {i for i, *_ in rows if i >= 1000} <= kept and not kept & {i for i, *_ in junk}


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_BYTES", 2000)
    monkeypatch.setattr(ann, "CANDIDATES", 16)
    r = np.random.default_rng(5)
    x = r.normal(size=(260, 8)) * np.exp(r.normal(size=(260, 1)))
    x[40:80] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [0.0] * 8), (600, [1.0, None] + [0.0] * 6), (700, [math.nan] * 8), (800, [1.0, math.inf] + [0.0] * 6), (None, x[3].tolist()), (900, [1.0, 2.0]), (50, x[50].tolist())]
    df = spark.createDataFrame([(*v, 1) for v in rows], "vec_id long, embedding array<double>, part int")
    got = ann.search(df, df.where("vec_id % 20 = 0"), 5)
    found = collections.defaultdict(list)
    for q in got.orderBy("query_id", "rank").collect():
        found[q.query_id].append((q.vec_id, q.score))
    fine = [(i, np.array(v)) for i, v in rows if i is not None and (i < 260)]
    for i in range(0, 260, 20):
        want = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x[i], v, strict=True))), j) for j, v in fine if j != i)[:5]
        assert [j for _, j in want] == [j for j, _ in found[i]] and np.allclose([s for s, _ in want], [s for _, s in found[i]])
    assert set(found) == set(range(0, 260, 20))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1 << 20, 5])
def test_neighbours_of_extreme_and_equal_vectors(spark, monkeypatch, pairs):
    monkeypatch.setattr(ann, "PAIRS", pairs)
    monkeypatch.setattr(ann, "LEAST_BYTES", 50)
    huge = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 5.0]), (3, [1e-310, 0.0]), (4, [1.0, 2.0]), (5, [1e160, -1e160]), (6, [3e-320, 1e-322])]
    same = [(10 + i % 40, [0.5, 0.25]) for i in range(120)]
    long = np.random.default_rng(15).normal(size=(6, 4000))
    rows = huge + same + [(20, [0.5, 0.25, 1.0]), (60, [0.5, 0.25, 2.0])] + [(70 + i, v.tolist()) for i, v in enumerate(long)]
    df = spark.createDataFrame([(*v, 0, "s") for v in rows], "vec_id long, embedding array<double>, row int, same string")
    got = collections.defaultdict(list)
    for x in ann.search(df, df.where("vec_id % 2 = 0"), 4).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))

    def far(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += (x - y) * (x - y)
        return math.sqrt(total)

    for query in {i for i, _ in rows if i % 2 == 0}:
        best = [sorted((far(q, v), i) for i, v in rows if i != query and len(v) == len(q)) for q in {tuple(v) for i, v in rows if i == query}]
        assert got[query] == sorted(x for b in best for x in b)[:4]


def test_bounds_hold_the_distance():
    r = np.random.default_rng(6)
    a, b = r.normal(size=(30, 64)), r.normal(size=(50, 64)) * 3
    low, high = ann.bounds(ann.Quantised.of(a), ann.Quantised.of(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert (low <= true).all() and (true <= high).all() and (high - low).max() < 1


def test_archives_are_read_by_as_many_tasks_as_their_bytes_need(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 4000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    r = random.Random(14)
    rows = [(i, f"http://h{i % 5}.example.com/{i}", "".join(r.choice("abcdef") for _ in range(1500))) for i in range(200)] + [(900, "http://big.example.com/", "".join(r.choice("abcdef") for _ in range(2_000_000)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back = warc.fetch(archive, warc.locate(archive, warc.keys_of(pages)))
    assert back.rdd.getNumPartitions() > 100
    assert sorted((x.page_id, x.body.decode()) for x in back.collect()) == [(i, p) for i, _, p in rows]


def test_archive_round_trip(spark):
    rows = [(3, "http://b.example.com/x", "same"), (1, "http://a.example.com/y?q=1#f", "same"), (2, None, None), (4, "https://B.example.com:443/x", ""), (None, "http://c.example.org/", "same"), (5, "u", "ü" * 40_000), (1, "http://a.example.com/y?q=1#f", "same")]
    pages = spark.createDataFrame([(*x, "k", 1) for x in rows], "page_id long, url string, html string, key string, length int")
    archive = warc.write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back = warc.fetch(archive, warc.locate(archive, warc.keys_of(pages))).collect()
    got = sorted((str(x.page_id), x.record_type, str(x.refers_to), x.payload_bytes, x.payload_digest) for x in back)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 1, "": 2, "ü" * 40_000: 5}
    want = sorted((str(i), "response" if first[t or ""] == i else "revisit", "None" if first[t or ""] == i else str(first[t or ""]), len((t or "").encode()), sha(t)) for i, _, t in rows)
    assert got == want
    assert {x.body.decode() for x in back if x.record_type == "response"} == {"same", "", "ü" * 40_000}
    assert warc.locate(archive, spark.createDataFrame([("nothing) ",)], "key string")).count() == 0
    empty = warc.write(pages.limit(0), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    assert warc.fetch(empty, warc.locate(empty, warc.keys_of(pages))).count() == 0


def test_lookup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "SHARD_LINES", 10)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/{i % 7}", f"body {i}") for i in range(60)], "page_id long, url string, html string")
    archive = warc.write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    assert len(archive.files) > 3 and archive.firsts == sorted(archive.firsts)
    some = warc.fetch(archive, warc.locate(archive, warc.keys_of(pages.where("page_id % 4 = 0")))).collect()
    assert sorted((x.page_id, x.body.decode()) for x in some) == [(i, f"body {i}") for i in range(0, 60, 4)]


def test_surt():
    assert warc.surt("https://User@WWW.Example.com:443/a/b?x=1#top") == "com,example,www)/a/b?x=1"
    assert warc.surt("http://example.org:8080") == "org,example:8080)/" and warc.surt(None) == "-)"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is very cheap today.</div>
{top}<h1>Title {n}</h1><p><b>Bold &amp; text {n}<br><p>Second   paragraph,
with <a href=x>a link</a> &eacute;.</p>{rest}{end}<div class="comments"><p>A reader says that this was nice to read, thanks a lot.</p></div>
<aside>More of the same</aside><form>Name <input name=q><button>Go</button></form><footer>&copy; all</footer></body></html>"""


def page(n, top="<article>", end="</article>", rest=""):
    return PAGE.format(n=n, top=top, end=end, rest=rest)


def test_extracts_articles(spark):
    rows = [(i, "http://one.example.com/x", page(i, rest="<ul><li>x</li><li>y</li></ul>" * (i % 2))) for i in range(6)]
    rows += [(10 + i, f"https://two.example.com/{i}", page(i, '<div class="c7"><div class="story">', "</div></div>", "<p>And one more paragraph of running text here.</p>" * i)) for i in range(1, 4)]
    rows += [(20, None, None), (21, "http://x.example.com", ""), (22, "http://x.example.com", "just text"), (23, "http://one.example.com/", "<article><p>cut off &am"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*x, "w", "h") for x in rows], "page_id long, url string, html string, wrapper string, host string")
    got = {x.page_id: x for x in html.extract_pages(df).collect()}
    assert len(got) == len(rows) - 1
    base = lambda n: [f"Title {n}", f"Bold & text {n}", "Second paragraph, with a link é."]
    for i in range(6):
        assert got[i].text == "\n".join(base(i) + ["x", "y"] * (i % 2)) and got[i].n_chars == len(got[i].text)
    for i in range(1, 4):
        assert got[10 + i].text == "\n".join(base(i) + ["And one more paragraph of running text here."] * i)
    assert got[20].text == got[21].text == "" and got[23].text == "cut off &am"
    assert html.extract_pages(df.limit(0)).count() == 0


def test_wrappers_merge_into_optional_and_repeated_items():
    trees = [html.json.dumps(html.skeleton(html.tree(f"<ul>{'<li>x</li>' * n}</ul>{tail}"))) for n, tail in ((1, ""), (3, "<hr><p>y</p>"), (2, "<p>z</p>"))]
    ul, p = html.json.loads(html.merge(trees))[2]
    assert ul[0] == "ul" and ul[2][0][:2] == ["li", "+"] and p[:2] == ["p", "?"]
    assert html.fold([["a", "", []], ["b", "", []]] * 3) == [["()", "+", [["a", "", []], ["b", "", []]]]]


def read_host(pages):
    """What extract_pages does for one host, in plain Python and without Spark; the wrapper and its decisions."""
    trees = [html.tree(p) for p in pages]
    form = html.merge(sorted({html.json.dumps(html.skeleton(t), ensure_ascii=False) for t in trees}))
    stats = {}
    for t in trees:
        for number, x in html.measure(t, html.Wrapper(form)).items():
            y = stats.setdefault(number, [0] * 5 + x[5:])
            stats[number] = [*(a + b for a, b in zip(x[:5], y[:5], strict=True)), min(x[5], y[5]), max(x[6], y[6])]
    return form, html.decide(form, stats)


NEUTRAL = """<body><div class="k1"><span>Start {a}</span> <a href=/x>{b}</a></div><div class="k2">{c} day in {b}.</div><div class="k3"><div class="k4"><p>Written with care for readers like you.</p>
<h1>{t}</h1>{ps}<div class="k5">Send us your own story about this, we read every letter that comes.</div></div></div><div class="k6">{a} and {c} and {b}</div></body>"""


def neutral_pages(r, n):
    word = lambda k: " ".join(r.choice(["stone", "water", "green", "garden", "morning", "letter", "window", "silver"]) for _ in range(k))
    made, want = [], []
    for _ in range(n):
        title, ps = word(4), [word(r.randint(3, 40)) for _ in range(r.randint(1, 6))]
        made.append(NEUTRAL.format(a=word(1), b=word(1), c=word(6), t=title, ps="".join(f"<p>{x}</p>" for x in ps)))
        want.append("\n".join([title, *ps]))
    return made, want


def test_the_wrapper_decides_where_names_say_nothing(spark):
    pages, want = neutral_pages(random.Random(8), 40)
    wrapper = html.Wrapper(*read_host(pages))
    got = [html.extract(p, wrapper) for p in pages]
    # the line that never differs is template, as is the box after the text; what varies outside is no article
    assert [g.replace("Written with care for readers like you.\n", "") for g in got] == want
    empty = [html.extract(p, html.Wrapper('["","",[]]')) for p in pages]
    assert sum(a != b for a, b in zip(got, empty, strict=True)) > 30
    undecided = [html.extract(p, html.Wrapper(read_host(pages)[0])) for p in pages]
    assert sum(a != b for a, b in zip(got, undecided, strict=True)) > 30
    df = spark.createDataFrame([(i, "http://n.example.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert [x.text for x in html.extract_pages(df).orderBy("page_id").collect()] == got


def test_what_is_shared_by_few_pages_or_repeats_stays_text():
    pages, want = neutral_pages(random.Random(9), 8)  # too few to tell template from text
    wrapper = html.Wrapper(*read_host(pages))
    assert all(f"{t}" in html.extract(p, wrapper) and "Send us" in html.extract(p, wrapper) for p, t in zip(pages, [w.split("\n")[0] for w in want], strict=True))
    lone = ["<html><body><nav><a href=x>m</a></nav><article><h1>One</h1><p>All there is to say of it.</p></article></body></html>"] * 12
    assert html.extract(lone[0], html.Wrapper(*read_host(lone))) == "One\nAll there is to say of it."
    copies = [page(1)] * 30
    assert html.extract(copies[0], html.Wrapper(*read_host(copies))) == "Title 1\nBold & text 1\nSecond paragraph, with a link é."


def test_titles_and_pages_of_rare_make():
    pages, want = neutral_pages(random.Random(15), 60)
    site = '<div class="top"><h1>The Paper</h1></div>'
    pages = [p.replace("<body>", f"<body>{site}") for p in pages]
    rare = f'<body>{site}<section><h1>An odd page</h1></section><table><tr><td class="q"><p>It is made quite unlike the rest of the pages here.</p><p>So it is judged by itself.</p></td></tr></table></body>'
    wrapper = html.Wrapper(*read_host([*pages, rare]))
    got = [html.extract(p, wrapper).replace("Written with care for readers like you.\n", "") for p in pages]
    assert got == want
    assert html.extract(rare, wrapper).endswith("It is made quite unlike the rest of the pages here.\nSo it is judged by itself.")
    assert "The Paper" not in html.extract(rare, wrapper)


def test_wrappers_do_not_depend_on_how_they_are_spread(spark, monkeypatch):
    pages, _ = neutral_pages(random.Random(10), 30)
    rows = [(i, f"http://h{i % 3}.example.com/", p) for i, p in enumerate([*pages, *(page(i, rest="<p>More of it here.</p>" * (i % 3)) for i in range(30))])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {x.page_id: x.text for x in html.extract_pages(df).collect()}
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html, "ROUND", 2)
    joined = {x.page_id: x.text for x in html.extract_pages(df.repartition(5)).collect()}
    assert whole == joined


@pytest.mark.parametrize("text", ["<div>" * 100_000, "<div>" * 3000 + "<p>end" + "</div>" * 3000, "<a " * 350_000, "<a " * 350_000 + ">", '<a " >"' * 100_000 + '"', "<" * 1_000_000, "<!--" * 200_000, "<p>x" * 50_000, "<script>" * 50_000, "&" * 500_000])
def test_bad_pages_end_soon(text):
    start = time.perf_counter()
    top = html.tree(text)
    form = html.merge([html.json.dumps(html.skeleton(top))])
    wrapper = html.Wrapper(form, html.decide(form, html.measure(top, html.Wrapper(form))))
    out = html.extract(text, wrapper)
    assert time.perf_counter() - start < 20 and ("end" not in text[-30_000:] or "<p>end" not in text or out == "end")


def test_alignment_of_long_lists():
    r = random.Random(12)
    for n in (30, 900):
        a = [f"k{r.randrange(n)}" for _ in range(n)]
        b = [x for x in a if r.random() < 0.8] + ["z"]
        pairs = html._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) > 0.5 * len(b)
    assert len(html._common(list("abcde") * 2, list("xbcdy") * 2)) == 6
    names = [f"n{i}" for i in range(20_000)]
    assert len(html._common(["x", *names], [*reversed(names[:5]), *names])) == len(names)
    items = [[f"div c{a}{b}", "", []] for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] * 10
    assert html.json.loads(html.merge([html.json.dumps(["", "", items])]))[2] and len(html.Wrapper(html.merge([html.json.dumps(["", "", items])])).places) <= html.MOST_ITEMS

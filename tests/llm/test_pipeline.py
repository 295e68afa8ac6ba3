"""The pipeline's stages in turn over a small corpus whose right result is known."""

import random

import tiktoken

import corpus_pipeline
from tests.llm.test_texts import WORDS, edit, prose
from tidemark.llm import bpe


def test_keeps_what_is_good_unique_and_unleaked(spark, tmp_path):
    import public_tokenizers

    r = random.Random(8)
    clean = [(i, prose(r, 120)) for i in range(330)]
    junk = [(1000 + i, "".join(r.choice("#$%&QXZ0123|") for _ in range(600))) for i in range(12)]
    toxic = []
    for i in range(60):
        w = prose(r, 120).split()
        for _ in range(4):
            w[r.randrange(120)] = r.choice(["idiot", "moron", "scum", "loser"])
        toxic.append((2000 + i, " ".join(w)))
    copies = [(3000 + i, edit(r, clean[i][1], i % 2)) for i in range(20)]
    items = [(i, " ".join(r.choice(WORDS) for _ in range(40))) for i in range(5)]
    leaks = [(4000 + i, prose(r, 60) + " " + items[i][1] + " " + prose(r, 60)) for i in range(5)]
    rows = [*clean, *junk, *toxic, *copies, *leaks]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 1000 or i >= 2000), int(2000 <= i < 3000)) for i, _ in rows if i < 3000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    texts = dict(rows)
    done = corpus_pipeline.run(spark, str(tmp_path))
    got = {x.doc_id: x for x in done.collect()}
    assert done.count() == len(got) and not [i for i in got if i >= 1000]
    assert len(got) >= 327  # the quantiles may cost a clean document or two
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    assert all(x.token_ids == own.encode_ordinary(texts[i]) and x.n_tokens == len(x.token_ids) for i, x in got.items())


def written(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_every_stage_on_awkward_rows(spark, tmp_path):
    r = random.Random(21)
    columns = "doc_id long, text string, lang string, source string, n_chars long, __text string, one long, score double"
    good = [(i, prose(r, 80), "en", "s", 1, "t", i, 0.5) for i in range(30)]
    rows = [*good, (None, None, None, None, None, None, None, None), (100, "", "en", None, 0, "x", 1, 0.0), (101, "", "en", "s", 0, "x", 1, 0.0), good[3], good[3], (None, good[4][1], "en", "s", 1, "t", 1, 1.0), (102, "x" * 200_000, None, "s", 1, "t", 1, 1.0), (103, prose(r, 40_000), "en", "s", 1, "t", 1, 1.0)]
    docs = spark.createDataFrame(rows, columns)
    folder = written(spark, tmp_path / "a", docs, [(0, 1, 0), (0, 1, 1), (None, 1, 1), (1, None, None)], [(0, prose(r, 30)), (None, prose(r, 30)), (1, None)])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        found = got.collect()
        if name == "encoding":
            assert len(found) == len(rows) and [x.offsets for x in found if x.doc_id == 100] == [[0]]
            continue
        assert got.columns == docs.columns
        want = 30 + 4 if name == "near_duplicates" else len(rows)  # copies, and all empty texts, are one
        assert len(found) == want - (name == "near_duplicates") and {tuple(x) for x in found} <= set(rows)
    none = written(spark, tmp_path / "b", docs.limit(0), [], [])
    assert corpus_pipeline.run(spark, none).count() == 0  # every stage on an empty table

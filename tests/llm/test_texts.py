"""Chat, sharding, encoding, words, decontamination, near duplicates: against brute force, on awkward rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from tidemark.llm import bpe, chat, decontamination, neardup, sharding
from tidemark.llm.common import cut
from tidemark.llm.words import words_of

AWKWARD = ["", " ", "a", "De.", "\n\t", "x" * 30_000, "it's   'll \U0001f600 ñandú 12³ ½", "</s>[INST] [\\INST]"]


def test_words_equal_a_regular_expression():
    texts = [*AWKWARD, "Ünïcode Straße_x2 a-b", "日本語 text"]
    w = words_of(texts)
    for i, text in enumerate(texts):
        own = w.owner == i
        assert [text[a - w.offsets[i] : b - w.offsets[i]] for a, b in zip(w.starts[own], w.ends[own], strict=True)] == re.findall(r"[^\W_]+", text)
    assert words_of(["Abc"]).hashes[0] == words_of(["x abC y"]).hashes[1]


def test_chat_reads_back_what_it_wrote(spark):
    odd = ["", None, "[INST]", "[\\INST] [\\\\/INST]", "</s>", "[", "\\", "[/ROLE][/TURN]", "a\nb", "<s>[ASST]x</s>", "$1 \\2"]
    rows = [(i // 4, i % 4, r, t, 9) for i, (r, t) in enumerate((r, t) for t in odd for r in ("user", "assistant", "system", None, "[/ROLE]x"))]
    rows += [(99, 0, "user", "same", 9), (99, 0, "user", "same", 9), (None, None, "user", "lost", 9)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int"))
    got = {r.conv_id: r for r in made.select("conv_id", "valid", "segments", chat.parse_chat(made.formatted).alias("back"), chat.loss_text(made.segments).alias("loss")).collect()}
    want = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        want[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort(key=lambda t: t)
        assert [(t.role, t.text) for t in got[c].back] == [t[1:] for t in turns]
        assert got[c].loss == "".join(t[2] for t in turns if t[1] == "assistant")
    assert not got[99].valid


def test_chat_states(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user")]
    made = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.valid for r in made.collect()} == {1: True, 2: False, 3: False}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def descend(key, leaves):
    """The tree walked in plain Python."""
    path = "null" if key is None else f"={key}"
    for level in ("region", "rack", "shard"):
        kids = collections.defaultdict(float)
        for x in leaves:
            kids[getattr(x, level)] += x.weight
        draw = lambda n: -math.log(((xxhash.xxh64_intdigest(f"{path}/{n}".encode(), 42) >> 11) + 1) / 2**53) / kids[n]  # noqa: B023, E731
        own = min(kids, key=lambda n: (draw(n), n))
        leaves, path = [x for x in leaves if getattr(x, level) == own], f"{path}/{own}"
    return own


def test_sharding_equals_a_walk_and_confines_movement(spark):
    df = spark.createDataFrame([(i, "t", i) for i in range(3000)] + [(None, None, 0), (7, "t", 0), (7, "t", 0)], "doc_id long, path string, node long")
    base = sharding.tree(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in base]
    lighter = [sharding.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 5 else 1.0) for x in base]
    trees = {"a": base, "b": sharding.tree(17), "c": heavier, "d": lighter, "e": sharding.grown(sharding.tree(5)), "f": sharding.tree(5)}
    done = sharding.assign(df, df.doc_id, trees)
    assert done.columns == [*df.columns, *trees]
    rows = done.collect()
    for r in rows[:300] + rows[-3:]:
        assert all(r[n] == descend(r.doc_id, [x for x in leaves if x.weight]) for n, leaves in trees.items())
    assert sharding.tree(17) == sharding.grown(base)
    assert all(r.b in (r.a, 16) and r.e in (r.f, 5) for r in rows)
    at = {x.shard: (x.region, x.rack) for x in base}
    for r in rows:
        if r.c != r.a:  # into the subtree that gained: its region from elsewhere, its rack within the region, the shard within the rack
            assert at[r.c][0] == at[5][0]
            assert at[r.a][0] != at[5][0] or at[r.c] == at[5]
            assert at[r.a] != at[5] or r.c == 5
        if r.d != r.a:  # out of the subtree that lost
            assert at[r.a][0] == at[5][0]
            assert at[r.d][0] != at[5][0] or at[r.a] == at[5]
            assert at[r.d] != at[5] or r.a == 5
    assert not any(r.d == 5 for r in rows)
    counts = collections.Counter(r.a for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) < 2 * min(counts.values())
    assert 100 < sum(r.b == 16 for r in rows) < 260 and 2.3 < sum(r.c == 5 for r in rows) / counts[5] < 3.4
    assert len({r.a for r in rows if r.doc_id == 7}) == 1
    # not what a flat choice among all shards gives
    flat = lambda key: min(range(16), key=lambda n: xxhash.xxh64_intdigest(f"={key}/{n}".encode(), 42))
    assert sum(r.a == flat(r.doc_id) for r in rows) < 0.3 * len(rows)
    assert sharding.assign(df.limit(0), df.doc_id, {"a": base}).count() == 0
    with pytest.raises(ValueError, match="weight"):
        sharding.assign(df, df.doc_id, {"a": [sharding.Leaf(0, 0, 0, 0.0)]})


def test_slots_have_no_gaps(spark):
    rows = [(i % 5 if i < 40 else 4, i // 2) for i in range(100)]
    df = cut(spark.createDataFrame([(*x, 0) for x in rows * 9], "shard int, doc_id long, place int").repartition(7))
    got = collections.defaultdict(list)
    for r in sharding.slots(df, "shard", 900, 5, run_rows=30).collect():
        got[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 900


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(bpe.default_vocabulary()))


def test_ids_equal_the_library(codec):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_vocabulary())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = AWKWARD + ["".join(r.choice("abstdmrevlSTé 1२9'''  \t\n  !?-—日😀\x85 \0") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    ids, cuts, _ = codec.encode(texts)
    for i, text in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == own.encode_ordinary(text)
        assert codec.decode(ids[cuts[i] : cuts[i + 1]]) == text.encode()


def test_long_words_equal_the_library_and_end_soon(codec):
    import public_tokenizers
    import tiktoken

    r = random.Random(16)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    texts = ["x" * 20_001, "ab" * 9_000, "aaab" * 5_000, "".join(r.choice("abcdefgh") for _ in range(20_000)), "".join(r.choice("aab") for _ in range(20_000)), "é" * 7_001]
    ids, cuts, _ = codec.encode(texts)
    for i, text in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == own.encode_ordinary(text)
    start = time.perf_counter()
    ids, cuts, _ = codec.encode(["x" * 1_000_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))])
    assert time.perf_counter() - start < 60 and codec.decode(ids[: cuts[1]]) == b"x" * 1_000_000
    pieces = ["".join(r.choice("abc") for _ in range(r.randint(1, 60))).encode() for _ in range(200)]
    ids, counts = codec.merger.merge(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [codec.merger._merge_long(p).tolist() if p not in codec.merger.whole else [codec.merger.whole[p]] for p in pieces]


def test_offsets_let_any_stretch_be_decoded(spark, codec):
    import public_tokenizers
    import regex

    texts = [*AWKWARD, "One two,  three's 44 \U0001f600\U0001f600 fünf"]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe.default_vocabulary()).collect()
    for x in got:
        pieces = regex.findall(public_tokenizers.PATTERN, texts[x.doc_id])
        ids, offsets = np.array(x.token_ids, np.int64), np.array(x.offsets)
        assert len(offsets) == len(pieces) + 1 and offsets[-1] == len(ids)
        assert [codec.decode(ids, offsets, i, i + 1).decode() for i in range(len(pieces))] == pieces
        assert codec.decode(ids, offsets, len(pieces) // 2).decode() == "".join(pieces[len(pieces) // 2 :])


def test_encoding_rows(spark):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 5), (3, "", 5)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), bpe.default_vocabulary()).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 2), ("3", 0), ("None", 0)]
    assert {r.decoded_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"hello world").hexdigest()}


WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_alignment_equals_the_textbook():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 4, 12).astype(np.uint64), r.integers(0, 4, 20).astype(np.uint64)
        h, best = np.zeros((13, 21)), 0.0
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
                best = max(best, h[i, j])
        assert decontamination.smith_waterman(a, b)[0] == pytest.approx(best)


def test_decontamination_finds_copies_and_edits(spark):
    r = random.Random(2)
    items = [(i, prose(r, 40)) for i in range(8)] + [(8, "too short"), (9, None), (None, prose(r, 40))]
    edited = items[1][1].split()
    for i in range(0, 40, 9):
        edited[i] = "zzz"
    docs = [
        (0, prose(r, 50) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(r, 50)), (1, " ".join(edited)), (2, prose(r, 400)), (3, None), (4, ""), (5, "too short"),
        (6, items[2][1] + " " + items[3][1]), (6, items[2][1] + " " + items[3][1]), (None, items[4][1] * 3), (7, prose(r, 60) + " ".join(items[5][1].split()[:6])),
    ]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.matches(table, bench).collect()
    assert sorted((str(x.doc_id), x.item_id) for x in got) == sorted([("0", 0), ("1", 1), ("6", 2), ("6", 3), ("6", 2), ("6", 3), ("None", 4)])
    whole = next(x for x in got if x.doc_id == 0)
    assert whole.score == 1.0 and docs[0][1][whole.start_char : whole.end_char].lower().replace(",", "") == items[0][1]
    clean = decontamination.clean(table, bench)
    assert sorted(x.doc_id for x in clean.collect()) == [2, 3, 4, 5, 7] and clean.columns == table.columns
    assert decontamination.matches(table, bench.limit(0)).count() == 0 and decontamination.matches(table.limit(0), bench).count() == 0


def test_matches_equal_aligning_every_pair(spark):
    """Every document against every item by the textbook; a match needs a seed in common, an alignment of enough score holds one here."""
    r = random.Random(31)
    words = [f"{a}{b}" for a in WORDS[:60] for b in "xyz"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(8, 50)))) for i in range(12)]
    docs = []
    for i in range(90):
        _, text = items[i % 12]
        own = text.split()[: r.randint(4, 60)]
        for _ in range(r.choice([0, 1, 3, 6])):
            at, what = r.randrange(len(own)), r.choice("edit drop add".split())
            own[at : at + 1] = {"edit": ["zzz"], "drop": [], "add": [own[at], "zzz"]}[what] if len(own) > 1 else own
        docs.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 300))) + " " + " ".join(own) + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 40)))))
    want = {}
    for d, text in docs:
        w = words_of([text])
        grams = set(w.grams(decontamination.SEED)[0].tolist())
        for i, item in items:
            own = words_of([item])
            score = decontamination.smith_waterman(own.hashes, w.hashes)[0] / len(own.hashes)
            if score >= decontamination.LEAST_SCORE and grams & set(own.grams(decontamination.SEED)[0].tolist()):
                want[d, i] = score
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 50 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_bound_holds_every_alignment():
    r = np.random.default_rng(7)
    for _ in range(300):
        a = r.integers(0, 30, int(r.integers(1, 25))).astype(np.uint64)
        b = np.concatenate([r.integers(0, 30, int(r.integers(0, 9))).astype(np.uint64), np.delete(a, r.integers(0, len(a), 3)), r.integers(0, 30, 9).astype(np.uint64)])
        assert decontamination.most(a, b) >= decontamination.smith_waterman(a, b)[0]


@pytest.mark.parametrize("places", [1 << 20, 30])
def test_decontamination_finds_edited_copies_that_are_common(spark, monkeypatch, places):
    monkeypatch.setattr(decontamination, "MOST_PLACES", places)
    r = random.Random(11)
    items = [(i, " ".join(f"{r.choice(WORDS)}{i}" for _ in range(20 + 20 * i))) for i in range(3)]
    edited = [f"zzz{i}" if i % 5 == 2 else x for i, x in enumerate(items[0][1].split())]
    docs = [(i, f"{prose(r, 30)} {' '.join(edited)} {prose(r, 30)}") for i in range(60)]
    docs += [(100 + i, f"{prose(r, 30)} {' '.join(items[1][1].split()[:20])} {prose(r, 30)}") for i in range(100)]
    docs += [(200 + i, f"{prose(r, 30)} {items[1][1]} {prose(r, 30)}") for i in range(6)]
    docs += [(300 + i, f"{prose(r, 30)} {' '.join(items[2][1].split()[:6])} {prose(r, 30)}") for i in range(80)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in decontamination.matches(table, bench).collect())
    assert got == [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(100)] + [(200 + i, 1) for i in range(6)]
    assert sorted(x.doc_id for x in decontamination.clean(table, bench).collect()) == list(range(300, 380))


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        grams = collections.Counter(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else collections.Counter({tuple(w) or ("#", text or ""): 1})
        sets.append({(g, j) for g, n in grams.items() for j in range(n)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root[i]] = min(names.get(root[i], doc_id), doc_id)
    return sorted((str(rows[i][0]), str(names.get(root[i]))) for i in range(len(rows)))


def edit(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("tile", [1000, 4])
def test_classes_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    r = random.Random(3)
    base = [prose(r, 120) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(40):  # chains of edits, so that links do not all go through one document
        rows.append((100 + i, edit(r, rows[-1][1] if i % 3 else base[i % 6], r.choice([0, 1, 2, 3]))))
    rows += [(300, None), (301, ""), (302, "?!"), (303, "?!"), (304, "a b"), (305, "A, b"), (306, "x y x y x y x y x y"), (307, "x y x y x y"), (None, base[0]), (5, base[5]), (308, prose(r, 3000))]
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, node int, bands string")
    got = neardup.classes(df)
    assert sorted((str(x.doc_id), str(x.class_id)) for x in got.collect()) == brute_classes(rows)
    if tile == 4:
        kept = neardup.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted(x.doc_id for x in kept.collect()) == sorted({int(c) for _, c in brute_classes(rows)})
        assert neardup.classes(df.limit(0)).count() == 0


def test_groups_that_their_leader_leaves_apart(spark, monkeypatch):
    """Chains and clusters in which most links do not go through the leader of a band."""
    r = random.Random(13)
    rows, base = [], prose(r, 100)
    for c in range(4):  # four clusters, each too far from the others, that share three quarters of a text
        own = base.split()[:75] + prose(r, 25).split()
        for i in range(12):
            rows.append((100 * c + i, edit(r, " ".join(own), r.choice([0, 1, 2]))))
    rows += [(900 + i, rows[i * 7][1]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for tile, size in ((1000, 16 << 20), (3, 16 << 20), (1000, 2000)):
        monkeypatch.setattr(neardup, "TILE", tile)
        monkeypatch.setattr(neardup, "TILE_BYTES", size)
        assert sorted((str(x.doc_id), str(x.class_id)) for x in neardup.classes(df).collect()) == want


def test_links_given_parts_and_sides():
    r = np.random.default_rng(9)
    sets = []
    for _ in range(5):
        whole = np.unique(r.integers(1, 1 << 40, 60)).astype(np.uint64)
        sets += [np.sort(r.choice(whole, 56, replace=False)) for _ in range(6)]
    all_links = neardup.link(sets)
    parts = np.array([i // 2 for i in range(30)])
    assert (neardup.link(sets, 0.8, parts) == neardup.link([*sets], 0.8, parts)).all()
    together = neardup.link(sets, 0.8, parts)
    for i in range(30):
        for j in range(30):
            if all_links[i] == all_links[j]:
                assert together[i] == together[j]
    sides = np.array([i % 2 for i in range(30)])
    apart = neardup.link(sets, 0.8, None, sides)
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    assert all(apart[i] == apart[j] for i in range(30) for j in range(30) if sides[i] != sides[j] and near(i, j))
    assert len(neardup.link([])) == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "same words here for all of us", f"s{i}", i) for i in range(20)] + [(2, "same words here for all of us", "z", 0), (None, None, "n", 1), (None, None, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, one long")
    kept = neardup.one_of_each(df.repartition(3))
    assert kept.columns == df.columns and [tuple(x) for x in kept.orderBy("doc_id").collect()] == [tuple(x) for x in neardup.one_of_each(df.repartition(7)).orderBy("doc_id").collect()]
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "None"]
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_signatures_agree_like_weighted_similarity():
    r = np.random.default_rng(4)
    a = {int(x): int(n) for x, n in zip(r.integers(1, 1 << 60, 300), r.integers(1, 5, 300), strict=True)}
    b = {k: max(1, n + int(r.integers(-1, 2))) for k, n in list(a.items())[:240]}
    keys = [*a, *b]
    sign = neardup.signatures(np.array(keys, np.uint64), np.array([0] * len(a) + [1] * len(b)), np.array([*a.values(), *b.values()]), 2, k=2000)
    true = sum(min(a[k], b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs((sign[0] == sign[1]).mean() - true) < 0.04 and (sign > 0).all()


def test_size_and_checksum(spark, tmp_path):
    rows = [(1, "añb"), (2, None), (3, ""), (4, "ü" * 3_000_000)]
    spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, shard long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op2_shards(spark, str(tmp_path)).collect()}
    assert [(got[i].size, got[i].text_crc32) for i in (1, 2, 3, 4)] == [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op2_shards(spark, f"{tmp_path}/none").count() == 0

"""Byte-level BPE: pre-tokenisation by scans over codepoint classes, cached pair merging, decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, settled, table, text_of

#: Classes of code points. Fixed values.
LETTER, NUMBER, OTHER, SPACE, WHITE = 0, 1, 2, 3, 4
#: Classes by what follows: a blank or white character before something else, an apostrophe that may begin a contraction
#: of one or two letters, and the end of a text.
LAST_SPACE, LAST_WHITE, SHORT, LONG, END = 5, 6, 7, 8, 9
#: White_Space of Unicode. Fixed values.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Contractions after an apostrophe. Fixed values.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")
#: What the scan knows of the token so far: nothing (the next character begins one), a run of letters, numbers or
#: others, a blank that joins what follows, white space, a contraction that still takes one or two letters.
FRESH, IN_L, IN_N, IN_O, JOIN, IN_W, TAKE1, TAKE2 = range(8)
#: Columns of one scanned row.
WIDTH = 64
#: Bytes of text that are encoded at a time.
STEP_BYTES = 1_000_000
#: Bytes of a piece beyond which its merges are taken from a heap.
LONG_BYTES = 1000
#: Words and their ids that one task keeps, about.
CACHE_WORDS = 250_000


@functools.cache
def codepoint_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    first = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)], np.uint8)
    kinds[first == ord("L")], kinds[first == ord("N")] = LETTER, NUMBER
    kinds[list(WHITE_SPACE)] = WHITE
    kinds[0x20] = SPACE
    return kinds


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(class, state) -> next state, and whether the character begins a token."""
    to, begins = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    runs = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}
    for kind, run in (*runs.items(), (SHORT, IN_O), (LONG, IN_O)):
        for state in range(8):
            to[kind, state], begins[kind, state] = run, state not in (run, JOIN)
    for state in range(8):
        if state not in (IN_O, JOIN):  # an apostrophe that begins a token and a contraction
            to[SHORT, state], to[LONG, state] = TAKE1, TAKE2
        for kind in (SPACE, WHITE):  # white space of which more follows
            to[kind, state], begins[kind, state] = IN_W, state != IN_W
        to[LAST_SPACE, state] = JOIN
        to[LAST_WHITE, state] = FRESH
        to[END, state] = FRESH
    to[LETTER, TAKE2], begins[LETTER, TAKE2] = TAKE1, False
    to[LETTER, TAKE1], begins[LETTER, TAKE1] = FRESH, False
    return to, begins


def scan(classes: np.ndarray) -> np.ndarray:
    """Where tokens begin. Rows of WIDTH characters become functions from state to state, which compose associatively;
    composed over all rows they give each row's first state, from which the columns follow side by side."""
    to, begins = transitions()
    n = len(classes)
    rows = -(-n // WIDTH)
    grid = np.full((rows, WIDTH), END, np.uint8)
    grid.ravel()[:n] = classes
    columns = np.ascontiguousarray(grid.T)
    step = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    flat = to.ravel()
    for kinds in columns:
        step = flat[(kinds.astype(np.uint16) * 8)[:, None] + step]
    through = step.copy()  # row i: from before row 0 (after doubling) to behind row i
    gap = 1
    while gap < rows:
        through[gap:] = np.take_along_axis(through[gap:].copy(), through[:-gap], axis=1)
        gap *= 2
    state = np.empty(rows, np.uint8)
    state[:1], state[1:] = FRESH, through[:-1, FRESH]
    starts, flags = np.empty((WIDTH, rows), bool), begins.ravel()
    for i, kinds in enumerate(columns):
        at = kinds.astype(np.uint16) * 8 + state
        starts[i], state = flags[at], flat[at]
    return np.ascontiguousarray(starts.T).ravel()[:n]


def boundaries(text: str, ends: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens begin in ``text``, in which the texts end at ``ends`` with one END character each."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = codepoint_classes()[cp]
    kinds[ends] = END
    following = np.append(kinds[1:], END)
    solid = (following < SPACE) & (kinds >= SPACE)
    kinds = np.where(solid & (kinds == SPACE), LAST_SPACE, np.where(solid & (kinds == WHITE), LAST_WHITE, kinds)).astype(np.uint8)
    marks = np.flatnonzero((cp == 0x27) & (following == LETTER))
    if len(marks):
        padded = np.append(cp, [0, 0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        for tail in SHORT_TAILS:
            kinds[marks[one == ord(tail)]] = SHORT
        for tail in LONG_TAILS:
            kinds[marks[(one == ord(tail[0])) & (two == ord(tail[1]))]] = LONG
    starts = scan(kinds)
    starts[ends] = False
    return np.flatnonzero(starts)


class Merger:
    """Ranks of byte strings, and the merging of pieces by them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {r: t for t, r in ranks.items()}
        self.most = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.most + b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.ids = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.joins = pairs
        slots = 1 << 22
        self.mask = slots - 1
        self.known = np.zeros(slots, bool)
        self.known[self._slot(keys)] = True
        self.whole = ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 20) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair put together; ``most`` where it is no token."""
        keys = left * self.most + right
        out = np.full(len(keys), self.most, np.int64)
        maybe = np.flatnonzero(self.known[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces on end, and how many each has: in every round each piece merges its leftmost pair of
        lowest rank, all pieces at once. Pieces beyond LONG_BYTES, which would take a round a merge, go one by one."""
        large = [i for i, p in enumerate(pieces) if len(p) > LONG_BYTES and p not in self.whole]
        if large:
            alone = {i: self._merge_long(pieces[i]) for i in large}
            short = [p for i, p in enumerate(pieces) if i not in alone]
            ids, counts = self.merge(short) if short else (np.empty(0, np.int64), np.zeros(1, np.int64))
            parts = iter(np.split(ids, np.cumsum(counts)[:-1]))
            whole = [alone[i] if i in alone else next(parts) for i in range(len(pieces))]
            return np.concatenate(whole), np.array([len(x) for x in whole])
        found = np.array([-1 if r is None else r for r in map(self.whole.get, pieces)], np.int64)
        rest = np.flatnonzero(found < 0).tolist()
        counts_of = np.ones(len(pieces), np.int64)
        if not rest:
            return found, counts_of
        sizes = np.array([len(pieces[i]) for i in rest])
        ids = self.single[np.frombuffer(b"".join(pieces[i] for i in rest), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), sizes)
        done_ids, done_owner = [], []
        ranks = np.full(len(ids), self.most, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(ranks, first)
            counts = np.diff(np.append(first, len(ids)))
            spread = np.repeat(best, counts)
            over = spread == self.most
            if over.any():
                done_ids.append(ids[over]), done_owner.append(owner[over])
                keep = ~over
                ids, owner, ranks, spread = ids[keep], owner[keep], ranks[keep], spread[keep]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == spread)
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            ids[hits] = ranks[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            at = moved[hits]
            ranks[at] = self.most
            inner = at[(at + 1 < len(ids)) & (owner[np.minimum(at + 1, len(ids) - 1)] == owner[at])]
            ranks[inner] = self.rank(ids[inner], ids[inner + 1])
            inner = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            ranks[inner] = self.rank(ids[inner], ids[inner + 1])
        done, of = np.concatenate(done_ids), np.concatenate(done_owner)
        counts_of[rest] = np.bincount(of, minlength=len(rest))
        flat = np.repeat(found, counts_of)
        flat[flat < 0] = done[np.argsort(of, kind="stable")]
        return flat, counts_of


    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece: pairs wait in a heap by rank and place, what a merge makes stale is passed over."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = np.append(self.rank(ids[:-1], ids[1:]), self.most).tolist()
        ids, n, most = ids.tolist(), len(ids), self.most
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks) if r < most]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = r, -1, most
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
                ranks[i] = self.joins.get(r * most + ids[after[i]], most)
                if ranks[i] < most:
                    heapq.heappush(heap, (ranks[i], i))
            else:
                ranks[i] = most
            if (left := before[i]) >= 0:
                ranks[left] = self.joins.get(ids[left] * most + r, most)
                if ranks[left] < most:
                    heapq.heappush(heap, (ranks[left], left))
        return np.array([x for x in ids if x >= 0], np.int64)


class Codec:
    """Encodes and decodes texts; keeps the ids of words met before, until it is told to forget them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger = Merger(ranks)
        self.forget()
        tokens = [self.merger.tokens.get(i, b"") for i in range(self.merger.most)]
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 21, np.uint32)
        self.begin = np.zeros(CACHE_WORDS, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self.merger.merge([w.encode("utf-8", "replace") for w in words])
        n, m = len(self.index), len(self.index) + len(words)
        at = int(self.begin[n])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        while m + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
        self.flat[at : at + len(ids)] = ids
        self.begin[n + 1 : m + 1] = at + np.cumsum(sizes)
        self.index.update(zip(words, range(n, m), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's ids begin (one entry more than texts), where each pre-token's ids begin."""
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = boundaries(joined, ends)
        owner = np.searchsorted(ends, starts)
        stops = np.append(starts[1:], len(joined))
        stops = np.minimum(stops, ends[owner]) if len(starts) else stops[:0]
        words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        if len(self.index) > CACHE_WORDS:
            self.forget()
        known = self.index
        new = list({w for w in words if w not in known})
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        begin = self.begin[at]
        sizes = self.begin[at + 1] - begin
        offsets = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)] if len(words) else np.empty(0, np.uint32)
        per_text = offsets[np.searchsorted(owner, np.arange(len(texts) + 1))]
        return ids, per_text, offsets

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids on end, and where those of ``ids[cuts[i]:]`` begin: with the cuts of texts, each text's
        bytes; with the offsets of pre-tokens that :meth:`encode` gives, each pre-token's."""
        sizes = self.lengths[ids]
        ends = np.append(0, np.cumsum(sizes))
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.at[ids] - ends[:-1], sizes)], ends[cuts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None, first: int = 0, last: int | None = None) -> bytes:
        """The bytes of all ids; with ``offsets``, those of the pre-tokens from ``first`` up to ``last`` alone."""
        if offsets is not None:
            ids = ids[offsets[first] : offsets[len(offsets) - 1 if last is None else last]]
        return self.decode_all(np.asarray(ids, np.int64), np.zeros(1, np.int64))[0].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def encode_documents(df: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids and offsets per row of ``df`` (doc_id, text).

    offsets: where each pre-token's ids begin, and their number last: any stretch of pre-tokens can be decoded by itself
    (see :meth:`Codec.decode`). Digests are of the bytes that the ids decode to.
    Null and empty texts have no tokens; repeated rows and null doc_ids give a row each; other columns play no part.
    The vocabulary file must lie at ``path`` on every machine. A text is encoded as a whole.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, offsets array<int>" * with_ids

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch, texts in chunks(batches, "text", STEP_BYTES):
            ids, cuts, offsets = codec.encode(texts)
            raw, ends = codec.decode_all(ids, cuts)
            raw, ends = memoryview(raw), ends.tolist()
            packed, begins = memoryview(ids.astype("<u4").tobytes()), (cuts * 4).tolist()
            out = [
                batch.column(0),
                pa.array(np.diff(cuts), pa.int64()),
                pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(begins, begins[1:], strict=False)], pa.string()),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()),
            ]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                # a text's offsets: those of its pre-tokens from its own first id on, and its number of ids
                first = np.searchsorted(offsets, cuts)
                sizes = np.diff(first) + 1
                own = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - first[:-1], sizes)
                starts = offsets[own] - np.repeat(cuts[:-1], sizes)
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(starts, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids", "offsets"] * with_ids])
        codec.forget()  # the worker may go on with another operator

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of all documents."""
    return encode_documents(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)

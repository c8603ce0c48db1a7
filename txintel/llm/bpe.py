"""Byte-level BPE encoding and decoding with a given vocabulary file.

Merging keeps a segment tree over the ranks of adjacent pairs: a leaf holds (rank, place) of the pair that starts there, an
inner node the least of its two children, so the root is the leftmost pair of lowest rank. A merge changes three leaves;
their paths to the root are renewed, until the root holds no mergeable pair. The trees of many words are rows of one
array and advance together. A long word has a tree of its own, and all its pairs of the root's rank merge in one step: what a
merge makes can only merge at a later rank, as the vocabulary made it later. Words once encoded are remembered, in a table of bounded size, for as long as the worker lives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.text import remembered, slices
from txintel.runtime import ship_package, table

#: The pattern that cuts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = regex.compile(PATTERN)
#: A space that white space or the end follows; texts without one can be cut at their spaces.
_LOOSE = regex.compile(r" (?:[\s\x1c-\x1f]|\Z)")
NONE = np.iinfo(np.int64).max
#: Bytes of a word beyond which it has a tree of its own.
LONG = 4096
#: Remembered words and bytes at most, and cells in one array of trees.
REMEMBERED, REMEMBERED_BYTES, CELLS = 250_000, 24 << 20, 1 << 18


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """first: id of each byte; pairs: sorted keys left << 20 | right with their ranks; merged: id that each rank makes."""

    first: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    pieces: list[bytes]
    special: dict[str, int]
    #: Whether every merge's parts were made by earlier ranks.
    in_order: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for piece, k in ids.items():
            pieces[k] = bytes(byte_of[c] for c in piece)
        for text, k in special.items():
            pieces[k] = text.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        made = {a + b: k for k, (a, b) in reversed(list(enumerate(merges)))}
        in_order = all(made.get(x, -1) < k for k, pair in enumerate(merges) for x in pair)
        return cls(np.array([ids[c] for c in letters], np.int64), keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int64), pieces, special, in_order)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)


def _merge(vocab: Vocabulary, seqs: list[bytes], width: int) -> list[bytes]:
    """Ids, as little-endian unsigned 32-bit integers, of byte strings of at most width (a power of two) bytes each."""
    n, bits = len(seqs), width.bit_length() - 1
    length = np.fromiter(map(len, seqs), np.int64, n)
    sym = vocab.first[np.frombuffer(b"".join(s.ljust(width, b"\0") for s in seqs), np.uint8)]
    place = np.arange(width)
    alive = (place < length[:, None]).ravel()
    nxt = np.where(place + 1 < length[:, None], place + 1, width).ravel()
    prv = np.tile(place - 1, n)
    right = np.roll(sym, -1)
    ranks = np.where(nxt < width, vocab.rank(sym, right), NONE).reshape(n, width)
    tree = np.full((n, 2 * width), NONE)
    tree[:, width:] = np.where(ranks < NONE, ranks << bits | place, NONE)
    for low in (1 << b for b in range(bits - 1, -1, -1)):
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    tree = tree.ravel()
    row = np.flatnonzero(tree[1 :: 2 * width] < NONE)
    while len(row):
        base, leaf = row * width, row * 2 * width
        root = tree[leaf + 1]
        i = root & (width - 1)
        new = vocab.merged[root >> bits]
        j = nxt[base + i]
        k = nxt[base + j]
        h = prv[base + i]
        sym[base + i] = new
        alive[base + j] = False
        nxt[base + i] = k
        more, less = k < width, h >= 0
        prv[(base + k)[more]] = i[more]
        after = np.where(more, vocab.rank(new, sym[np.where(more, base + k, 0)]), NONE)
        before = np.where(less, vocab.rank(sym[np.where(less, base + h, 0)], new), NONE)
        tree[leaf + width + j] = NONE
        tree[leaf + width + i] = np.where(after < NONE, after << bits | i, NONE)
        tree[(leaf + width + h)[less]] = np.where(before < NONE, before << bits | h, NONE)[less]
        nodes = [width + i, width + j, width + np.where(less, h, i)]
        for _ in range(bits):
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                tree[leaf + x] = np.minimum(tree[leaf + 2 * x], tree[leaf + 2 * x + 1])
        row = row[tree[leaf + 1] < NONE]
    ends = np.cumsum(alive.reshape(n, width).sum(axis=1)) * 4
    flat = sym[alive].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _merge_long(vocab: Vocabulary, word: bytes) -> bytes:
    """Ids of one byte string: the tree holds ranks, and all pairs of the root's rank, of those that overlap every other one
    from the left, merge together."""
    n, none = len(word), np.iinfo(np.int32).max
    width = 1 << max(1, (n - 1).bit_length())
    sym = vocab.first[np.frombuffer(word, np.uint8)].astype(np.int32)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive = np.ones(n, bool)

    def ranks(at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place."""
        out = np.full(len(at), none, np.int32)
        has = np.flatnonzero(nxt[at] < n)
        found = vocab.rank(sym[at[has]].astype(np.int64), sym[nxt[at[has]]].astype(np.int64))
        out[has] = np.where(found < NONE, found, none)
        return out

    tree = np.full(2 * width, none, np.int32)
    for a in range(0, n, 1 << 20):
        some = np.arange(a, min(n, a + (1 << 20)))
        tree[width + some] = ranks(some)
    low = width >> 1
    while low:
        tree[low : 2 * low] = np.minimum(tree[2 * low : 4 * low : 2], tree[2 * low + 1 : 4 * low : 2])
        low >>= 1
    while tree[1] < none:
        rank, i = tree[1], np.ones(1, np.int64)
        while i[0] < width:
            i = (2 * i[:, None] + np.arange(2)).ravel()
            i = i[tree[i] == rank]
        i -= width
        joined = np.concatenate(([False], nxt[i[:-1]] == i[1:]))  # shares a symbol with the one before
        turn = np.arange(len(i)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(i))))
        i = i[turn % 2 == 0]
        j = nxt[i]
        sym[i], alive[j] = vocab.merged[rank], False
        nxt[i] = nxt[j]
        after = nxt[i]
        prv[after[after < n]] = i[after < n]
        h = prv[i]
        again = np.unique(np.concatenate((i, h[h >= 0])))
        tree[width + j] = none
        tree[width + again] = ranks(again)
        nodes = np.unique(np.concatenate((again, j)) + width) >> 1
        while nodes[0]:
            nodes = nodes[np.concatenate(([True], nodes[1:] != nodes[:-1]))]
            tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
            nodes = nodes >> 1
    return sym[alive].astype("<u4").tobytes()


def merge_words(vocab: Vocabulary, seqs: list[bytes]) -> list[bytes]:
    """Ids of each byte string by itself."""
    out: list[bytes] = [b""] * len(seqs)
    by_width: dict[int, list[int]] = {}
    for k, s in enumerate(seqs):
        if len(s) > LONG and vocab.in_order:
            out[k] = _merge_long(vocab, s)
            continue
        by_width.setdefault(1 << max(1, (len(s) - 1).bit_length()), []).append(k)
    for width, some in by_width.items():
        step = max(1, CELLS // width)
        for at in range(0, len(some), step):
            part = some[at : at + step]
            for k, ids in zip(part, _merge(vocab, [seqs[k] for k in part], width), strict=True):
                out[k] = ids
    return out


class Encoder:
    """Encodes whole texts; keeps what it knows of words between calls."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.held = vocab, {}, 0
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None

    def _parts(self, text: str) -> list[str]:
        """Pieces whose encodings, joined, are the text's: each starts where a word does."""
        if " " not in text or _LOOSE.search(text):
            return _WORDS.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *map(" ".__add__, rest)]

    def _learn(self, missing: list[str]) -> None:
        known, mixed, fresh = self.known, [], []
        for p in missing:
            if p.isalpha() or p[0] == " " and p[1:].isalpha():
                fresh.append(p)
            else:
                mixed.append((p, _WORDS.findall(p)))
        fresh = dict.fromkeys(fresh)
        for _, ws in mixed:
            for w in ws:
                if w not in known:
                    fresh[w] = None
        known.update(zip(fresh, merge_words(self.vocab, [w.encode() for w in fresh]), strict=True))
        for p, ws in mixed:
            known[p] = b"".join([known[w] for w in ws])
        self.held += sum(map(len, missing))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        cut, missing = [], set()
        for text in texts:
            runs = self.special.split(text) if self.special and any(s in text for s in self.vocab.special) else [text]
            runs = [r if k % 2 else self._parts(r) for k, r in enumerate(runs)]
            cut.append(runs)
            for r in runs[::2]:
                missing.update(r)
        missing.difference_update(self.known)
        self._learn(list(missing))
        known = self.known.__getitem__
        return [b"".join(self.vocab.special[r].to_bytes(4, "little") if k % 2 else b"".join(map(known, r)) for k, r in enumerate(runs)) for runs in cut]


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """The text of ids given as little-endian unsigned 32-bit integers; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocab.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, ids) for every row; ids as little-endian unsigned 32-bit integers, binary.

    path names the vocabulary file on the driver; executors get its tables by broadcast, whose size the vocabulary fixes.
    A null text counts as empty and gives no ids. Rows keep their number, nulls in other columns and repeats.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    rest = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("bpe", path), lambda: Encoder(shared.value))
        for part, texts in slices(batches, text_col):
            ids = encoder.encode([(t or b"").decode() for t in texts])
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), counts, pa.array(ids, pa.binary())], names=[*rest, "n_tokens", "ids"])

    return docs.select(*rest, text_col).mapInArrow(run, _schema(docs.select(*rest), "n_tokens bigint, ids binary"))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., decoded) for every row of ids; special tokens are written out, null ids give an empty text."""
    spark = encoded.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    rest = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for part, ids in slices(batches, ids_col):
            texts = pa.array([decode(vocab, x or b"") for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), texts], names=[*rest, "decoded"])

    return encoded.select(*rest, ids_col).mapInArrow(run, _schema(encoded.select(*rest), "decoded string"))


def bpe_round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, ids, decoded): bpe_encode and bpe_decode in one pass, so that one worker a task is enough."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    rest = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("bpe", path), lambda: Encoder(shared.value))
        for part, texts in slices(batches, text_col):
            ids = encoder.encode([(t or b"").decode() for t in texts])
            counts, back = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([decode(encoder.vocab, x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), counts, pa.array(ids, pa.binary()), back], names=[*rest, "n_tokens", "ids", "decoded"])

    return docs.select(*rest, text_col).mapInArrow(run, _schema(docs.select(*rest), "n_tokens bigint, ids binary, decoded string"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: n_tokens and the digests of ids and of the text decoded from them."""
    both = bpe_round_trip(docs, path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document of the whole table, encoded and decoded; bpe_encode says what odd rows give."""
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())

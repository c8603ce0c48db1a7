"""Language-model scores by subword lattice likelihood.

The pieces of an existing vocabulary weight all segmentations of a text: a unigram model over pieces gives each segmentation
the product of its pieces' probabilities, and a forward recursion in log space sums over all of them. Pieces never cross
words, so a document's probability is the product over its words (each with the mark that starts it) and the end. The
vocabulary's scores give the first probabilities; expected counts over all training tokens (forward-backward over each distinct
word, times its count) renew them. The probabilities of all texts sum to at most 1. That is score.

Beside it, word_score is what the same lattice gives with one more arc for each training word, across the whole word at its
discounted relative frequency; what the discount leaves is the weight of the paths over pieces.

Words are counted once; each distinct word goes through the lattice once; a document's words meet their counts and
probabilities by a join on their hash. The most frequent words are broadcast instead, a fixed number at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm.quality import held_out
from txintel.llm.text import slices, words
from txintel.runtime import checkpoint, ship_package, table

#: Passes over the training words, and what each piece gets besides its expected count.
PASSES, EXTRA = 3, 0.1
#: Hot words are broadcast: so many of the most frequent at most, none of them longer than so many bytes.
HOT_WORDS, HOT_BYTES = 100_000, 40
#: Bytes of a word beyond which it goes through the lattice by itself, in windows of as many bytes.
LONG = 4096
#: Words that go through the lattice together: its steps are as many for a few words of one length as for thousands.
_DISTINCT, _PAIRS, _LATTICE = 200_000, 300_000, 32_768
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LN10 = float(np.log(10.0))


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's start being a space, and their first weights by the order of the vocabulary's scores.

    Pieces that can't stand in a word are left out; all single bytes are there, the space alone too.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): -1e6 for b in range(256)}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode().lower()
        if piece == b" " or b" " not in piece[1:] and piece[:1].strip() + piece[1:].strip():
            found[piece] = max(found.get(piece, -1e9), model.get_score(k))
    pieces = sorted(found, key=lambda p: (-found[p], p))
    return pieces, 1.0 / (np.arange(len(pieces)) + 10.0)


class Lattice:
    """Forward and backward sums over all segmentations, for many words at a time."""

    def __init__(self, index: tuple[np.ndarray, np.ndarray, int], log_p: np.ndarray):
        self.keys, self.ids, self.longest = index
        self.log_p = log_p
        self.there = np.zeros(1 << 20, bool)
        self.there[self.keys >> np.uint64(44)] = True

    @classmethod
    def index(cls, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted hashes of the pieces, the pieces' places, and the longest piece's bytes; made once and broadcast."""
        keys = np.array([cls._hash_one(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        return keys[order], order, max(map(len, pieces))

    @staticmethod
    def _next(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h * _STEP + byte + np.uint64(1)) * _MIX
        return h ^ (h >> np.uint64(29))

    @classmethod
    def _hash_one(cls, piece: bytes) -> int:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = cls._next(h, np.array([b], np.uint64))
        return int(h[0])

    def _arcs(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, length) -> rows in which a piece stands there, and the pieces. codes: one row a word, all of one length."""
        out, width = {}, codes.shape[1]
        h = np.zeros(codes.shape, np.uint64)
        for n in range(1, min(width, self.longest) + 1):
            h = self._next(h[:, : width - n + 1], codes[:, n - 1 :])
            maybe = np.flatnonzero(self.there[h >> np.uint64(44)].ravel())
            if not len(maybe):
                continue
            key = h.ravel()[maybe]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            row, start = np.divmod(maybe[good], width - n + 1)
            piece = self.ids[at[good]]
            order = np.argsort(start, kind="stable")
            edges = np.searchsorted(start[order], np.arange(width - n + 2))
            for s in range(width - n + 1):
                if edges[s + 1] > edges[s]:
                    own = order[edges[s] : edges[s + 1]]
                    out[s, n] = row[own], piece[own]
        return out

    @staticmethod
    def _sum(terms: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        """Log of the sum of exponentials of each row's terms."""
        top = np.full(rows, -np.inf)
        for row, x in terms:
            top[row] = np.maximum(top[row], x)
        total, safe = np.zeros(rows), np.where(np.isfinite(top), top, 0.0)
        for row, x in terms:
            total[row] += np.exp(x - safe[row])
        return np.where(total > 0, safe + np.log(np.maximum(total, 1e-300)), -np.inf)

    def _forward(self, arcs: dict, rows: int, width: int) -> np.ndarray:
        alpha = np.full((width + 1, rows), -np.inf)
        alpha[0] = 0.0
        for end in range(1, width + 1):
            terms = [(arcs[end - n, n][0], alpha[end - n][arcs[end - n, n][0]] + self.log_p[arcs[end - n, n][1]]) for n in range(1, min(end, self.longest) + 1) if (end - n, n) in arcs]
            alpha[end] = self._sum(terms, rows)
        return alpha

    def _groups(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the words of one length, and their bytes after the space that starts them."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            n = int(sizes[part[0]])
            step = max(1, (1 << 20) // (n + 1))
            for at in range(0, len(part), step):
                own = part[at : at + step]
                codes = np.frombuffer(b"".join([b" " + texts[k] for k in own.tolist()]), np.uint8)
                yield own, codes.reshape(len(own), n + 1).astype(np.uint64)

    def _long(self, word: bytes) -> float:
        """Natural log-probability of one long word: windows of its arcs, and of the forward sums only those that a piece reaches
        back to, so memory doesn't grow with the word."""
        alpha, at = [0.0], 0  # sums of the last places, up to at
        while at < len(word):
            stop = min(len(word), at + LONG)
            low = max(0, at + 1 - self.longest)
            codes = np.frombuffer(word[low:stop], np.uint8).astype(np.uint64)
            into: list[list[tuple[int, float]]] = [[] for _ in range(stop - at)]
            h = np.zeros(len(codes), np.uint64)
            for n in range(1, min(len(codes), self.longest) + 1):
                h = self._next(h[: len(codes) - n + 1], codes[n - 1 :])
                place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                start = np.flatnonzero((self.keys[place] == h) & (np.arange(len(h)) + low + n > at))
                for s, p in zip(start.tolist(), self.log_p[self.ids[place[start]]].tolist(), strict=True):
                    into[s + low + n - at - 1].append((n, p))
            for arcs in into:
                terms = [alpha[-n] + p for n, p in arcs if n <= len(alpha)]
                top = max(terms, default=-inf)
                alpha.append(top + log(sum([exp(x - top) for x in terms])) if top > -inf else -inf)
            alpha, at = alpha[-self.longest :], stop
        return alpha[-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Natural log-probability of each word, the mark of its start included."""
        out, short = np.zeros(len(texts)), [k for k, t in enumerate(texts) if len(t) <= LONG]
        for own, codes in self._groups([texts[k] for k in short]):
            out[np.array(short)[own]] = self._forward(self._arcs(codes), len(own), codes.shape[1])[-1]
        for k, t in enumerate(texts):
            if len(t) > LONG:
                out[k] = self._long(b" " + t)
        return out

    def expected(self, texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in the words, each word taken counts times. A word beyond LONG bytes is taken in
        parts of that many, as if each were a word."""
        cut = [t[at : at + LONG] for t in texts for at in range(0, max(1, len(t)), LONG)]
        texts, counts = cut, np.repeat(counts, [max(1, -(-len(t) // LONG)) for t in texts])
        out = np.zeros(len(self.log_p))
        for own, codes in self._groups(texts):
            rows, width = codes.shape
            arcs = self._arcs(codes)
            alpha = self._forward(arcs, rows, width)
            beta = np.full((width + 1, rows), -np.inf)
            beta[width] = 0.0
            pieces, uses = [], []
            for start in range(width - 1, -1, -1):
                terms = []
                for n in range(1, min(width - start, self.longest) + 1):
                    if (start, n) in arcs:
                        row, piece = arcs[start, n]
                        terms.append((row, beta[start + n][row] + self.log_p[piece]))
                        pieces.append(piece), uses.append(np.exp(alpha[start][row] + terms[-1][1] - alpha[width][row]) * counts[own[row]])
                beta[start] = self._sum(terms, rows)
            if pieces:
                out += np.bincount(np.concatenate(pieces), np.concatenate(uses), len(out))
        return out


def _probabilities(weights: np.ndarray, ends: float) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end of a text."""
    total = weights.sum() + ends
    return np.log(weights / total), float(np.log(ends / total))


def batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of that many, the last one smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = rows - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(held[-1].num_rows)
            if held[-1].num_rows == room:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_ids(words_: list[bytes]) -> pa.Array:
    """What words are joined by: their XXH64."""
    return pa.array(np.fromiter(map(xxhash.xxh64_intdigest, words_), np.uint64, len(words_)).view(np.int64))


def count_words(docs: DataFrame, text_col: str = "text", train_col: str = "train") -> DataFrame:
    """(word, c) for every word of any row; c counts it in the training rows."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        others: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            more = list(others.difference(counts))
            batch = pa.RecordBatch.from_arrays([pa.array([*counts, *more], pa.binary()), pa.array([*counts.values(), *[0] * len(more)], pa.int64())], names=["word", "c"])
            counts.clear(), others.clear()
            return batch

        for part, texts in slices(batches, text_col):
            for train, t in zip(part.column(train_col).to_pylist(), texts, strict=True):
                for some in words(t):
                    counts.update(some) if train else others.update(some)
                    if len(counts) + len(others) > _DISTINCT:
                        yield flush()
        yield flush()

    return docs.select(text_col, train_col).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counted: DataFrame, index: tuple[np.ndarray, np.ndarray, int], weights: np.ndarray, ends: int, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and the end, from all training tokens. What reaches the driver is one number a piece."""
    log_p, log_end = _probabilities(weights, float(weights.sum()) / 500)
    spark = counted.sparkSession
    ship_package(spark)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((index, log_p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*shared.value), 0.0
            for some in batched(batches, _LATTICE):
                total = total + lattice.expected(some.column("word").to_pylist(), some.column("c").to_numpy().astype(float))
            if not isinstance(total, float):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["piece", "uses"])

        found = counted.filter("c > 0").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(len(weights), EXTRA)
        uses[found["piece"].to_numpy(np.int64)] += found["uses"].to_numpy(np.float64)
        log_p, log_end = _probabilities(uses, ends + EXTRA)
    return log_p, log_end


def lattice_scores(docs: DataFrame, path: str, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score) for every row; scores are log10.

    A null text is an empty one: only its end is a token. Rows of one id and text share one score; a null id is held out.
    Without training rows every word is unknown and all pieces are as likely.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = held_out(id_col, folds, fold)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), out.alias("held_out"))
    counted = checkpoint(count_words(rows.withColumn("train", ~F.col("held_out"))))
    ends = rows.filter(~F.col("held_out")).count()
    tokens, kinds, once, twice = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), *(F.count(F.when(x, 1)) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2))).first()
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    below = float(tokens + 1 * (kinds + 1))
    by_pieces = discount * (kinds - (ends > 0)) / tokens if tokens and kinds > 1 else 1.0
    pieces, weights = load_pieces(path)
    index = Lattice.index(pieces)
    log_p, log_end = fit(counted, index, weights, ends, passes)
    word_end = float(np.log(ends / tokens)) if ends else log_end
    model = spark.sparkContext.broadcast((index, log_p))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for some in batched(batches, _LATTICE):
            ws, c = some.column("word").to_pylist(), some.column("c").to_numpy()
            whole = (c - discount).clip(0) / max(1, tokens)
            paths = lattice.scores(ws)
            both = np.logaddexp(np.log(by_pieces) + paths, np.log(whole, out=np.full(len(whole), -np.inf), where=whole > 0))
            hot_word = pa.array([w if len(w) <= HOT_BYTES else None for w in ws], pa.binary())
            yield pa.RecordBatch.from_arrays([word_ids(ws), hot_word, some.column("c"), pa.array(paths / _LN10), pa.array(both / _LN10)], names=["word", "hot", "c", "p", "pw"])

    scored = checkpoint(counted.mapInArrow(score_words, "word bigint, hot binary, c bigint, p double, pw double"))
    # the most frequent words, by steps of a quarter of a power of two, as many steps as HOT_WORDS has room for
    step = F.floor(F.log2("c") * 4)
    least, room = None, HOT_WORDS
    for r in sorted(scored.filter((F.col("c") > 0) & F.col("hot").isNotNull()).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        room -= r.n
        if room < 0:
            break
        least = r.step
    found = scored.filter((F.col("c") > 0) & (step >= least)).filter(F.col("hot").isNotNull()).select("hot", "c", "p", "pw").collect() if least is not None else []
    hot = spark.sparkContext.broadcast({bytes(r.hot): (r.c, float(np.log10((r.c + 1) / below)), r.p, r.pw) for r in found})
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        keys: list[int] = []
        sizes: list[int] = []
        ws: list[bytes] = []
        ns: list[int] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), sizes)), word_ids(ws), pa.array(ns, pa.int32())], names=["key", "word", "n"])
            keys.clear(), sizes.clear(), ws.clear(), ns.clear()
            return batch

        for part, texts in slices(batches, "text"):
            for key, t in zip(part.column("key").to_pylist(), texts, strict=True):
                own = [(b" " + key.to_bytes(8, "little", signed=True), 1)]  # no word has a space; counts the rows of this key
                for some in words(t):
                    own += [x for x in Counter(some).items() if x[0] not in known]
                    keys.append(key), sizes.append(len(own))
                    a, b = zip(*own, strict=True) if own else ((), ())
                    ws.extend(a), ns.extend(b)
                    own = []
                    if len(ws) > _PAIRS:
                        yield flush()
        yield flush()

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for part, texts in slices(batches, "text"):
            n, seen, base, score, score_w = [], [], [], [], []
            for t in texts:
                size, k, b, s, v = 1, int(ends > 0), float(np.log10((ends + 1) / below)), log_end / _LN10, word_end / _LN10
                for some in words(t):
                    size += len(some)
                    for w, times in Counter(filter(known.__contains__, some)).items():
                        x = known[w]
                        k, b, s, v = k + times, b + times * x[1], s + times * x[2], v + times * x[3]
                n.append(size), seen.append(k), base.append(b), score.append(s), score_w.append(v)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "id", "held_out")), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), *(pa.array(x, pa.float64()) for x in (base, score, score_w))], names=["key", "id", "held_out", "n_tokens", "seen", "base", "s", "sw"])

    met = keyed.select("key", "text").mapInArrow(pairs, "key bigint, word bigint, n int").join(scored.select("word", "c", "p", "pw"), "word", "left")
    sums = met.groupBy("key").agg(
        F.sum(F.when(F.col("c").isNull(), F.col("n"))).alias("times"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("k"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / below)).alias("b"),
        F.sum(F.col("n") * F.col("p")).alias("s_cold"),
        F.sum(F.col("n") * F.col("pw")).alias("sw_cold"),
    )
    kind = dict(rows.dtypes)["id"]
    base = keyed.select("key", "id", "held_out", "text").mapInArrow(hot_sums, f"key bigint, id {kind}, held_out boolean, n_tokens bigint, seen bigint, base double, s double, sw double")
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("times")
    return base.join(sums, "key").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("seen") + part("k")).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + part("b")).alias("base_score"),
        (F.col("s") + part("s_cold")).alias("score"),
        (F.col("sw") + part("sw_cold")).alias("word_score"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document of the whole table; lattice_scores says what odd rows give."""
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary_path())

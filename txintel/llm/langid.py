"""Language identification by interpolated Kneser-Ney character models, one a language.

A text is the sequence of its words, runs of letters in lower case; a model predicts each letter and each word's end from up
to order - 1 characters before it, back to the word's start. Hashes of all n-grams stand in one sorted array; beside
each, a column a language has its discounted probability and, as a context, the weight of the shorter history. The language
of least cross-entropy per character wins; thresholds set on other labelled rows reject texts that no model explains.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.llm.bpe import _schema
from txintel.llm.quality import held_out
from txintel.llm.text import chunks, remembered, slices
from txintel.runtime import ship_package, table

ORDER = 4
#: Rows of each language that the models learn from, and further rows that set its threshold, in expectation.
FIT_ROWS, CALIBRATION_ROWS = 2000, 1000
#: Of a language with fewer rows, the share that its model learns from; the rest sets its threshold. Of one with no more than FEW
#: the model learns from all, and the threshold is that of all languages.
FIT_SHARE, FEW = 0.67, 20
#: Bounds on what the fit brings to the driver: distinct words of a language, the most frequent, and characters of one.
FIT_WORDS, FIT_CHARS = 100_000, 64
#: Share of a language's own texts beyond its threshold before the safety factor.
TAIL, SAFETY = 0.002, 3.0
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def letter_words(text: bytes | None) -> Iterator[list[bytes]]:
    """Lists of words: runs of bytes that aren't ASCII non-letters, in lower case; other non-letters go in letters_of()."""
    for piece in chunks(text or b""):
        low = piece.translate(_LETTERS) if piece.isascii() else piece.decode().lower().encode().translate(_LETTERS)
        yield low.split()


def letters_of(word: bytes) -> str:
    s = word.decode()
    return s if s.isalpha() else "".join(filter(str.isalpha, s))


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For the text of the words, each between spaces: characters, the longest n-gram allowed to end at each place, and for
    each n the hash of the n-gram that ends there."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = np.flatnonzero(codes == 32)
    since = np.arange(len(codes)) - np.repeat(space, np.diff(np.append(space, len(codes))))
    since[space[1:]] = np.diff(space)
    longest = np.minimum(since + 1, order)
    longest[0] = 1
    hashes = [np.zeros(len(codes), np.uint64)]
    for _ in range(order):
        before = np.concatenate((hashes[-1][:1] * 0, hashes[-1][:-1])) if len(hashes) > 1 else hashes[-1]
        h = (before * _STEP + codes + np.uint64(1)) * _MIX
        hashes.append(h ^ (h >> np.uint64(29)))
    return codes, longest, hashes


@dataclass
class Models:
    """langs, sorted keys of n-grams, and for each key and language the discounted probability and the weight below it."""

    langs: list[str]
    order: int
    keys: np.ndarray
    own: np.ndarray
    below: np.ndarray
    floor: np.ndarray
    centre: np.ndarray
    limit: np.ndarray
    sure: float = 0.5

    @classmethod
    def learn(cls, counts: dict[str, dict[str, int]], order: int = ORDER) -> Models:
        """From each language's words with their counts."""
        langs = sorted(counts)
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        letters = {c for ws in counts.values() for w in ws for c in w}
        floor = np.full(len(langs), 1.0 / (len(letters) + 2))
        for k, lang in enumerate(langs):
            words = [w for w in counts[lang] if w]
            if not words:
                continue
            codes, longest, h = _grams(words, order)
            n_of = np.array([counts[lang][w] for w in words], np.float64)
            weight = np.concatenate(([0.0], np.repeat(n_of, [len(w) + 1 for w in words])))
            place = np.arange(len(codes))
            uniq = {}
            for n in range(1, order + 1):
                at = place[(longest >= n) & (place > 0)]
                key, first, back = np.unique(h[n][at], return_index=True, return_inverse=True)
                uniq[n] = (key, at[first], np.bincount(back, weight[at], len(key)))
            for n in range(1, order + 1):
                key, at, count = uniq[n]
                if n < order:
                    more, more_at, _ = uniq[n + 1]
                    ends, times = np.unique(h[n][more_at], return_counts=True)
                    after = np.zeros(len(key))
                    after[np.searchsorted(key, ends)] = times
                    starts = (codes[at - n + 1] == 32) & (n > 1)
                    count = np.where(starts | (after == 0), count, after)
                ones, twos = float((count == 1).sum()), float((count == 2).sum())
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
                context = h[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
                held, back = np.unique(context, return_inverse=True)
                total = np.bincount(back, count, len(held))
                found.append((k, key, (count - discount).clip(0) / total[back], held, discount * np.bincount(back, minlength=len(held)) / total))
        keys = np.unique(np.concatenate([np.zeros(1, np.uint64), *(x for f in found for x in (f[1], f[3]))]))
        own, below = np.zeros((len(keys), len(langs)), np.float32), np.ones((len(keys), len(langs)), np.float32)
        for k, key, p, held, rest in found:
            own[np.searchsorted(keys, key), k] = p
            below[np.searchsorted(keys, held), k] = rest
        return cls(langs, order, keys, own, below, floor, np.zeros(len(langs)), np.full(len(langs), np.inf))

    def _rows(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word (no word empty) and its end under each language."""
        codes, longest, h = _grams(words, self.order)
        root = int(np.searchsorted(self.keys, np.uint64(0)))
        above = np.full(len(codes), root)
        p = np.broadcast_to(self.floor.astype(np.float32), (len(codes), len(self.langs))).copy()
        for n in range(1, self.order + 1):
            use = np.flatnonzero(longest >= n)
            rows = np.full(len(codes), -1)
            rows[use] = self._rows(h[n][use])
            if n > 1:
                above = np.concatenate(([-1], before[:-1]))  # noqa: F821
            hold = use[above[use] >= 0]
            p[hold] *= self.below[above[hold]]
            has = use[rows[use] >= 0]
            p[has] += self.own[rows[has]]
            before = rows
        p[0] = 1.0
        sizes = np.array([len(w) + 1 for w in words])
        starts = np.concatenate(([1], 1 + np.cumsum(sizes)[:-1]))
        return np.add.reduceat(np.log(np.maximum(p, 1e-30)), starts, axis=0)


class Identifier:
    """Scores whole texts; remembers words, in tables of bounded size, for as long as the worker lives."""

    def __init__(self, models: Models, most: int = 100_000):
        self.models, self.size = models, max(1000, min(most, (32 << 20) // (4 * max(1, len(models.langs)))))
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((self.size, len(models.langs)), np.float32)
        self.chars = np.zeros(self.size, np.int64)

    def _sums(self, words: list[bytes], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities and characters of each run of words; starts: where the runs begin, none of them empty."""
        missing = set(words).difference(self.known)
        if len(self.known) + len(missing) > self.size:
            self.known = {}
            missing = set(words)
            if len(missing) > self.size:
                self.size = len(missing)
                self.scores, self.chars = np.zeros((self.size, len(self.models.langs)), np.float32), np.zeros(self.size, np.int64)
        if missing:
            at = len(self.known)
            fresh = list(missing)
            spelt = [letters_of(w) for w in fresh]
            new = np.arange(at, at + len(fresh))
            full = np.array([bool(s) for s in spelt])
            self.scores[new[~full]], self.chars[new[~full]] = 0, 0
            if full.any():
                real = [s for s in spelt if s]
                self.scores[new[full]], self.chars[new[full]] = self.models.word_scores(real), [len(s) + 1 for s in real]
            self.known.update(zip(fresh, new.tolist(), strict=True))
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return np.add.reduceat(self.scores[rows], starts, axis=0, dtype=np.float64), np.add.reduceat(self.chars[rows], starts)

    def totals(self, texts: list[bytes | None], most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """For each text: log-probability under each language, and characters (0: no letter)."""
        scores, chars = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), np.int64)
        words: list[bytes] = []
        of: list[int] = []
        starts: list[int] = []

        def flush() -> None:
            if words:
                s, c = self._sums(words, starts)
                np.add.at(scores, of, s)
                np.add.at(chars, of, c)
                words.clear(), of.clear(), starts.clear()

        for k, text in enumerate(texts):
            for some in letter_words(text):
                if some:
                    starts.append(len(words))
                    of.append(k)
                    words.extend(some)
                    if len(words) >= most:
                        flush()
        flush()
        return scores, chars

    def identify(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, rejected, cross-entropy and characters of each text."""
        m = self.models
        scores, chars = self.totals(texts)
        n = np.maximum(chars, 1)
        if not m.langs:
            nothing = np.zeros(len(texts))
            return ["und"] * len(texts), nothing, np.ones(len(texts), bool), nothing, chars
        entropy = -scores / n[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        odds = np.exp(-np.clip((entropy - least[:, None]) * np.minimum(n, 64)[:, None], 0, 700)).sum(axis=1)
        score = np.where(chars > 0, 1.0 / odds, 0.0)
        beyond = (least - m.centre[best]) * np.sqrt(np.minimum(n, 2000)) > m.limit[best]
        langs = [m.langs[b] if c else "und" for b, c in zip(best.tolist(), chars.tolist(), strict=True)]
        return langs, score, (chars == 0) | beyond | (score < m.sure), np.where(chars > 0, least, 0.0), chars


class Shared:
    """A broadcast of models and a name for them; their size is bounded by the sample they learned from."""

    def __init__(self, spark: SparkSession, models: Models):
        self.broadcast = spark.sparkContext.broadcast(models)
        self.id = uuid.uuid4().hex  # workers keep models under it, so no two states of them may share one

    @property
    def value(self) -> Models:
        return self.broadcast.value


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Shared:
    """Models and thresholds from labelled rows that aren't held out: about fit_rows and calibration_rows of each language, by
    a hash of the id. Of the words of those, each language's FIT_WORDS most frequent count, longer ones in parts of FIT_CHARS;
    these numbers bound what the driver and the executors hold."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Shared(spark, Models.learn({}, order))
    dice = F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    number = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(float(n)))))
    many = number[F.col("lang")]
    fitted = F.when(many <= FEW, many).otherwise(F.least(F.lit(float(fit_rows)), many * FIT_SHARE))
    sample = rows.withColumn("rank", dice * number[F.col("lang")]).withColumn("fit", F.col("rank") < fitted).filter(F.col("fit") | (F.col("rank") < fitted + calibration_rows))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for part, texts in slices(batches, "text"):
            for lang, t in zip(part.column("lang").to_pylist(), texts, strict=True):
                own = counts.setdefault(lang, Counter())
                for some in letter_words(t):
                    own.update(some)
                    for w in [w for w in set(some) if len(w) > FIT_CHARS]:
                        times, whole = own.pop(w), w.decode()
                        for at in range(0, len(whole), FIT_CHARS):
                            own[whole[at : at + FIT_CHARS].encode()] += times
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    tallied = sample.filter("fit").select("lang", "text").mapInArrow(tally, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    told = tallied.withColumn("turn", turn).filter(F.col("turn") <= FIT_WORDS).select("lang", "word", "n").toArrow()
    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for lang, word, n in zip(told["lang"].to_pylist(), told["word"].to_pylist(), told["n"].to_pylist(), strict=True):
        s = letters_of(word)
        if s:
            counts[lang][s] = counts[lang].get(s, 0) + n
    models = Models.learn({k: c for k, c in counts.items() if c}, order)
    first = Shared(spark, models)
    judged = identify(sample.filter("not fit").select("lang", "text"), first, keep=("lang",), prefix="")
    seen = judged.filter("chars > 0 and lang_pred = lang").select("lang", "entropy", "chars", "score").toPandas()
    _calibrate(models, seen)
    return Shared(spark, models)


def _calibrate(models: Models, seen) -> None:
    """Centres and limits of each language's cross-entropy from rows that the models haven't learned from; a language with
    few of them takes the limit, and with fewest the centre, of all. sure: the least score that isn't rejected, a half or what
    nearly all of these rows reach, whichever is less."""
    if not len(seen):
        return
    beyond, middle = [], float(seen["entropy"].median())
    for k, lang in enumerate(models.langs):
        own = seen[seen["lang"] == lang]
        models.centre[k] = own["entropy"].median() if len(own) >= 5 else middle
        beyond.append((own["entropy"] - models.centre[k]) * np.sqrt(own["chars"].clip(upper=2000)))
    models.sure = min(0.5, float(seen["score"].quantile(TAIL)))
    every = np.concatenate(beyond)
    for k, b in enumerate(beyond):
        models.limit[k] = SAFETY * max(float(np.quantile(b if len(b) >= 50 else every, 1 - TAIL)), 1.0)


def identify(docs: DataFrame, shared: Shared, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """(keep..., lang_pred, score, rejected, entropy, chars), the new names after prefix, for every row.

    A null text or one without letters is `und`, score 0, and rejected, as is everything if there are no models. Rejected too is
    a text whose cross-entropy lies beyond its language's calibrated limit, or whose score, the language's share among all, is
    below the calibrated least.
    """
    ship_package(docs.sparkSession)
    rest = list(keep)
    both = rest if text_col in rest else [*rest, text_col]
    names = [prefix + c for c in ("lang_pred", "score", "rejected", "entropy", "chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(("langid", shared.id), lambda: Identifier(shared.value))
        for part, texts in slices(batches, text_col, 512):
            langs, score, rejected, entropy, chars = known.identify(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected), pa.array(entropy), pa.array(chars)], names=[*rest, *names])

    more = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean", "double", "bigint"), strict=True))
    return docs.select(*both).mapInArrow(run, _schema(docs.select(*rest), more))


def held_out_column() -> Column:
    return held_out().alias("held_out")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document of the whole table; identify says what odd rows give."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out_column(), "lang_pred", "score", "rejected")

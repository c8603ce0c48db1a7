"""Language ID, quality and language model: held-out accuracy, definitions and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.util import SF, crc, empty_docs, odd_docs, words
from txintel.llm import langid, lm, quality


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in langid.op6_langid(spark, sf).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([got[r.doc_id].rejected for r in rows]) < 0.01


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    shared = langid.train(docs)
    got = langid.identify(docs, shared, keep=("doc_id", "text", "score", "rejected"), prefix="p_").collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.p_lang_pred == "und") == (not letters) and 0 <= r.p_score <= 1
        assert letters or r.p_rejected
    assert langid.identify(empty_docs(spark), shared).count() == 0
    none = langid.identify(docs, langid.train(empty_docs(spark))).collect()
    assert {r.lang_pred for r in none} == {"und"} and all(r.rejected for r in none)


def test_models_are_distributions():
    m = langid.Models.learn({"a": {"abba": 3, "ab": 5, "b": 2}, "b": {"baa": 4, "aab": 1}}, 3)

    def total(prefix, lang):
        """Probability of all next characters after a prefix, by scoring words that share it."""
        p = lambda w: m.word_scores([w])[0, lang]
        end = p(prefix) if prefix else -math.inf
        return end, p

    for lang in (0, 1):
        words_ = ["a", "b", "aa", "ab", "ba", "bb"]
        s = np.exp(m.word_scores(words_)[:, lang])
        assert (s > 0).all() and s.sum() < 1
    own = m.word_scores(["abba", "baa"])
    assert own[0, 0] > own[0, 1] and own[1, 1] > own[1, 0]


def plain_kneser_ney(counts, order, floor):
    """Log-probability of a word and its end, by dictionaries."""
    raw, more = [Counter() for _ in range(order + 1)], [defaultdict(set) for _ in range(order + 1)]
    for w, c in counts.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for n in range(1, min(i + 1, order) + 1):
                raw[n][s[i - n + 1 : i + 1]] += c
                if n < min(i + 1, order):
                    more[n][s[i - n + 1 : i + 1]].add(s[i - n])
    own, below = {}, {}
    for n in range(1, order + 1):
        count = {g: c if n == order or n > 1 and g[0] == " " or not more[n][g] else len(more[n][g]) for g, c in raw[n].items()}
        ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
        total, kinds = Counter(), Counter()
        for g, c in count.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        own |= {(n, g): max(c - d, 0) / total[g[:-1]] for g, c in count.items()}
        below |= {(n, h): d * kinds[h] / total[h] for h in total}

    def score(w):
        s, out = f" {w} ", 0.0
        for i in range(1, len(s)):
            p = floor
            for n in range(1, min(i + 1, order) + 1):
                g = s[i - n + 1 : i + 1]
                if (n, g[:-1]) in below:
                    p = p * below[n, g[:-1]] + own.get((n, g), 0.0)
            out += math.log(p)
        return out

    return score


def test_models_are_interpolated_kneser_ney():
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8)))
    counts = {lang: {word(): rng.randint(1, 4) for _ in range(120)} for lang in ("x", "y")}
    letters = {c for ws in counts.values() for w in ws for c in w}
    for order in (1, 2, 4):
        m = langid.Models.learn(counts, order)
        asked = [*list(counts["x"])[:40], *[word() for _ in range(40)], "zzz", "q"]
        got = m.word_scores(asked)
        for k, lang in enumerate(m.langs):
            plain = plain_kneser_ney(counts[lang], order, 1 / (len(letters) + 2))
            assert np.allclose(got[:, k], [plain(w) for w in asked], rtol=1e-4)


def test_a_language_of_one_row_is_learned(spark):
    rows = [(k, "the cat sat on the mat and the dog ran away " * 3, "en") for k in range(40)] + [(1000 + k, f"{w} gaktu vorni plazi kremo duntar", lang) for k, (lang, w) in enumerate((f"l{n}", "zz" * (n + 1)) for n in range(6)) if crc(1000 + k, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.train(docs).value.langs) == {r[2] for r in rows if crc(r[0], 5)}


def test_long_words_and_many_words_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_WORDS", 30)
    rows = [(k, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop") + " " + "é" * 5000, "en") for k in range(30)]
    got = langid.identify(docs := spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.train(docs)).collect()
    assert {r.lang_pred for r in got} == {"en"} and not any(r.rejected for r in got)


def plain_statistics(text):
    """The fourteen statistics from their definitions, over the whole text's bytes and words."""
    b = (text or "").encode()
    ws = b.split()
    n, size = len(ws), len(b)
    count = lambda f: sum(map(f, b))
    upper, letters = count(lambda c: 65 <= c <= 90), count(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
    share = lambda k, of: math.log((k + 0.5) / (of + 50))
    p = [c / size for c in Counter(b).values()]
    return [
        math.log1p(n), math.log1p(sum(map(len, ws)) / max(1, n)), share(upper, letters), share(count(lambda c: 48 <= c <= 57), size),
        share(count(lambda c: c in b".,;:?'\"()-"), size), share(count(lambda c: c in b"#$%&*+/<=>@[\\]^_`{}~"), size), share(b.count(b"|"), size), share(b.count(b"!"), size),
        share(b.count(b"\n"), size), share(count(lambda c: c >= 128), size), share(sum(x == y for x, y in zip(ws, ws[1:])), n),
        math.log((len(set(ws)) + 1) / (n + 1)), math.sqrt(sum(len(w) < 4 for w in ws) / max(1, n)), -sum(x * math.log(x) for x in p),
    ]


def test_statistics_are_their_definitions(spark):
    texts = [r.text for r in odd_docs(spark).select("text").collect()]
    for t in texts:
        assert np.allclose(quality.statistics(None if t is None else t.encode()), plain_statistics(t))


def test_word_scores_do_not_depend_on_company():
    m = langid.Models.learn({"x": {"house": 3, "mouse": 2, "us": 1}}, 4)
    alone = [m.word_scores([w])[0, 0] for w in ("house", "zebra", "u")]
    assert np.allclose(alone, m.word_scores(["house", "zebra", "u"])[:, 0])


def test_rejects_noise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(1, "zqxw kvjx qqzz wxkj " * 200), (2, "漢字仮名交じり文" * 400)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(noise, langid.train(docs)).collect())


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[k].score, y, got[k].predicted) for k, y in labels.items() if got[k].held_out]
    pos, neg = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.95
    assert np.mean([p == 1 for _, y, p in held if y == 1]) > 0.97
    assert all(r.held_out == (crc(k, 5) == 0) and r.predicted == int(r.score >= 0.3) for k, r in got.items())


def test_quality_odd_rows_and_no_labels(spark):
    docs = odd_docs(spark)
    rows = quality.with_statistics(docs, ("doc_id", "score"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for model in (quality.fit(rows, labels), quality.fit(rows, labels.limit(0)), quality.fit(rows, labels.filter("quality = 1"))):
        got = quality.scored(rows, model, "p").collect()
        assert len(got) == docs.count() and all(0 <= r.p <= 1 for r in got)
    assert quality.scored(quality.with_statistics(empty_docs(spark), ("doc_id",)), model).count() == 0


def test_discriminant_is_the_posterior():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(4000, 3)) @ np.diag([1, 2, 0.5]) + 1, 1: rng.normal(size=(8000, 3))}
    m = quality.discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, 3, pooled=0.0, ridge=0.0)
    at = rng.normal(size=(50, 3))

    def density(v, a):
        mean, cov = v.mean(0), np.cov(v.T, bias=True)
        d = a - mean
        return np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)) / np.sqrt(np.linalg.det(cov)) * (len(v) + 1)

    p1, p0 = density(x[1], at), density(x[0], at)
    assert np.allclose(m.score(at), p1 / (p0 + p1), atol=1e-9)


def test_statistics_of_pieces_equal_the_whole(monkeypatch):
    from txintel.llm import text

    sample = ("Some Words, some MORE words | here!\n" * 3000).encode()
    whole = quality.statistics(sample)
    monkeypatch.setattr(text.chunks, "__defaults__", (1000,))
    assert np.allclose(quality.statistics(sample), whole)
    assert all(map(math.isfinite, quality.statistics(None) + quality.statistics(b"")))


@pytest.fixture(scope="module")
def pieces():
    return lm.load_pieces(lm.vocabulary_path())


def test_lattice_sums_all_segmentations(pieces):
    names, weights = pieces
    log_p, _ = lm._probabilities(weights, 1.0)
    lattice, p = lm.Lattice(lm.Lattice.index(names), log_p), dict(zip(names, log_p, strict=True))

    def paths(w):
        if not w:
            return [(0.0, [])]
        return [(p[w[:n]] + s, [w[:n], *rest]) for n in range(1, len(w) + 1) if w[:n] in p for s, rest in paths(w[n:])]

    some = [b"the", b"nation", b"\xc3\xa9t", b"x,y", b"aaaa"]
    for w, s in zip(some, lattice.scores(some), strict=True):
        assert s == pytest.approx(np.logaddexp.reduce([x for x, _ in paths(b" " + w)]), abs=1e-9)
    uses = lattice.expected(some, np.ones(len(some)))
    want = Counter()
    for w in some:
        all_ = paths(b" " + w)
        z = np.logaddexp.reduce([x for x, _ in all_])
        for x, path in all_:
            for piece in path:
                want[piece] += np.exp(x - z)
    assert all(uses[k] == pytest.approx(want.get(n, 0.0), abs=1e-9) for k, n in enumerate(names))
    assert np.isfinite(lattice.scores([b"long" * 500])).all()


def test_long_words_go_in_windows(pieces, monkeypatch):
    """The same sums whatever the window, and memory that a word's length doesn't change."""
    import random
    import tracemalloc

    names, weights = pieces
    log_p, _ = lm._probabilities(weights, 1.0)
    lattice, rng = lm.Lattice(lm.Lattice.index(names), log_p), random.Random(1)
    some = [bytes(rng.choice(b"theanrsi_-=.") for _ in range(n)) for n in (1, 2, 24, 25, 26, 100, 700)]
    want = lattice.scores(some)
    for window in (1, 3, 50):
        monkeypatch.setattr(lm, "LONG", window)
        assert np.allclose([lattice._long(b" " + w) for w in some], want)
    monkeypatch.setattr(lm, "LONG", 4096)
    word = bytes(rng.choice(b"ABCDEFGHabcdefgh0123") for _ in range(300_000))
    tracemalloc.start()
    found = lattice.scores([word, word[:3000]])
    uses = lattice.expected([word[:50_000]], np.ones(1))
    assert tracemalloc.get_traced_memory()[1] < 100e6 and np.isfinite(found).all() and found[0] < found[1]
    tracemalloc.stop()
    assert sum(u * len(n) for u, n in zip(uses, names, strict=True)) == pytest.approx(50_000 + 13)  # a mark starts each part


def test_scores_are_those_of_a_plain_model(spark, monkeypatch):
    """The whole model on a small vocabulary: counts, re-estimation by enumerated segmentations, both scores."""
    vocabulary = [bytes([b]) for b in b" abc"] + [b" a", b"ab", b"bc", b"abc", b" abc"]
    first = np.array([3.0, 1, 2, 1, 2, 1, 3, 1, 1])
    monkeypatch.setattr(lm, "load_pieces", lambda path: (vocabulary, first))
    docs = [(k, t) for k, t in enumerate(["abc ab abc c", "A b\tab cab", "", "abcabc c c c", "bca abc ab", None, "cc bb aa abc", "ab ab ca ca", "bbb"])]
    train = [words(t) for k, t in docs if crc(k, 7) != 2]
    counts = Counter(w for t in train for w in t)
    ends, total = len(train), sum(counts.values()) + len(train)

    def paths(w):
        return [[]] if not w else [[p, *rest] for p in vocabulary if w.startswith(p) for rest in paths(w[len(p) :])]

    weight = dict(zip(vocabulary, first, strict=True))
    ends_weight = first.sum() / 500
    for _ in range(lm.PASSES):
        z = sum(weight.values()) + ends_weight
        new = dict.fromkeys(vocabulary, lm.EXTRA)
        for w, c in counts.items():
            all_ = [(math.prod(weight[p] / z for p in path), path) for path in paths(b" " + w.encode())]
            whole = sum(x for x, _ in all_)
            for x, path in all_:
                for p in path:
                    new[p] += c * x / whole
        weight, ends_weight = new, ends + lm.EXTRA
    z = sum(weight.values()) + ends_weight
    once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    word = lambda w: sum(math.prod(weight[p] / z for p in path) for path in paths(b" " + w.encode()))
    mixed = lambda w: max(counts[w] - discount, 0) / total + discount * len(counts) / total * word(w)
    want = {k: (math.log10(ends_weight / z) + sum(math.log10(word(w)) for w in words(t)), math.log10(ends / total) + sum(math.log10(mixed(w)) for w in words(t))) for k, t in docs}
    got = lm.lattice_scores(spark.createDataFrame(docs, "doc_id long, text string"), "unused").collect()
    assert len(got) == len(docs) and {r.doc_id for r in got if r.held_out} == {k for k, _ in docs if crc(k, 7) == 2}
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id][0], rel=1e-9) and r.word_score == pytest.approx(want[r.doc_id][1], rel=1e-9)


def test_re_estimation_and_words_gain_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def per_token(passes):
        rows = [r for r in lm.lattice_scores(docs, lm.vocabulary_path(), passes=passes).collect() if r.held_out]
        return [sum(r[c] for r in rows) / sum(r.n_tokens for r in rows) for c in ("score", "word_score")]

    (learned, by_words), (first, _) = per_token(lm.PASSES), per_token(0)
    print(by_words, learned, first)
    assert by_words > learned > first + 0.3


def test_lm_base_and_scores(spark):
    docs = odd_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    got = lm.lattice_scores(docs, lm.vocabulary_path()).collect()
    assert len(got) == len(rows)
    train = [words(r.text) + [None] for r in rows if r.doc_id is not None and crc(r.doc_id, 7) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = words(r.text) + [None]
        out = r.doc_id is None or crc(r.doc_id, 7) == 2
        want[r.doc_id, out, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert all(r.score > -12 * r.n_tokens for r in held)
    assert lm.lattice_scores(empty_docs(spark), lm.vocabulary_path()).count() == 0

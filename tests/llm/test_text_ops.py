"""BPE, licences, mixing and sharding against libraries and plain versions."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import regex

from tests.llm.util import SF, empty_docs, odd_docs, words
from txintel.llm import bpe, licenses, mixing, queries, sharding


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    docs = odd_docs(spark)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = bpe.token_digests(docs, bpe.vocabulary_path()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.token_digests(empty_docs(spark), bpe.vocabulary_path()).count() == 0


def test_bpe_words_of_many_shapes():
    import random

    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Encoder(bpe.Vocabulary.load(bpe.vocabulary_path()))
    rng = random.Random(1)
    alpha = "aab  c'stre\n\t\r\x0b\x1c\x85\xa0 　éßñ漢1²Ⅷ_-|!#😀́٣"
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * n for n in range(1, 70)] + [" ".join(["ab" * k for k in range(40)])]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == tok.encode(t, add_special_tokens=False).ids


def test_bpe_long_words(monkeypatch):
    """A tree of its own gives what the library gives, for short words too; a long one takes seconds."""
    import random
    import time

    from tokenizers import Tokenizer

    tok, vocab = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Vocabulary.load(bpe.vocabulary_path())
    rng = random.Random(3)
    assert vocab.in_order
    some = ["a" * n for n in range(1, 40)] + ["".join(rng.choice(a) for _ in range(rng.randint(1, 300))) for a in ("ab", "aaab", "etaoinshrdlu", "éßa") for _ in range(60)]
    for w in [*some, "".join(rng.choice("etaoinshrdlucm") for _ in range(30_000))]:
        ids = tok.encode(w, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", bpe._merge_long(vocab, w.encode()))) == ids
    began = time.time()
    ids = bpe.Encoder(vocab).encode(["".join(rng.choice("ABCDEFGHabcdefghxyz") for _ in range(400_000))])[0]
    assert time.time() - began < 30 and len(ids) // 4 < 400_000


WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(label, k) for phrase, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
    return len(ws), places


def test_licences_base_and_labels(spark):
    docs = odd_docs(spark)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, places = plain_base(r.text)
        want[r.doc_id, n, len(places), min((k for _, k in places), default=None), max((k for _, k in places), default=None), ",".join(sorted({x for x, _ in places}))] += 1
    got = licenses.license_report(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert licenses.license_report(empty_docs(spark)).count() == 0


def brute_match(scanner, tokens):
    """Longest run that ends at each token and stands in some template."""
    cuts = [[scanner.ids[w] for some in licenses.license_words(t.encode()) for w in some] for _, t in licenses.TEMPLATES]
    held = {tuple(c[i:j]) for c in cuts for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    return [max((n for n in range(1, k + 2) if tuple(tokens[k + 1 - n : k + 1]) in held), default=0) for k in range(len(tokens))]


def test_matching_statistics_and_chains():
    import random

    s = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES, 4, 0.8)
    rng = random.Random(4)
    for _ in range(30):
        t = [w for some in licenses.license_words(rng.choice(licenses.TEMPLATES)[1].encode()) for w in some][:25]
        tokens = [s.ids[w] for w in t]
        for _ in range(3):
            tokens[rng.randrange(len(tokens))] = rng.randint(1, len(s.ids))
        assert [n for _, n in s.automaton.statistics(tokens)] == brute_match(s, tokens)
    for label, text in licenses.TEMPLATES:
        ws = text.split()
        if len(ws) > 30:
            torn = " ".join([*ws[:20], "changed", *ws[21:]])
            assert label in {x for x, *_ in s.scan(("intro words here " + torn + " and more").encode())["spans"]}
            # a third of a notice isn't the notice, though a short notice may stand in it whole
            part = s.scan(" ".join(ws[: len(ws) // 3]).encode())["spans"]
            assert all(b - a < 14 and c == 1.0 for _, a, b, c in part)
    assert s.scan(b"Released under a blue moon, the moon of version 2 and more of it")["spans"] == []


def brute_chains(file, template, shortest, stretch):
    """Most tokens of the template that runs of at least shortest tokens, in order in file and template, cover."""
    runs = []
    for i in range(len(file)):
        for j in range(len(template)):
            if file[i] == template[j] and not (i and j and file[i - 1] == template[j - 1]):
                n = next((n for n in range(1, len(file) + 1) if i + n >= len(file) or j + n >= len(template) or file[i + n] != template[j + n]), 0)
                if n >= min(shortest, len(template)):
                    runs.append((i, j, n))
    runs.sort()
    best = [(n, i) for i, _, n in runs]
    for k, (i, j, n) in enumerate(runs):
        for m, (a, b, c) in enumerate(runs[:k]):
            skip = max(0, a + c - i, b + c - j)
            if a < i and b < j and skip < n and i + n - best[m][1] <= stretch * len(template):
                best[k] = max(best[k], (best[m][0] + n - skip, best[m][1]))
    return runs, max((b[0] for b in best), default=0)


def test_matches_and_chains_are_those_of_brute_force():
    import random

    rng = random.Random(6)
    for trial in range(60):
        names = "abcdefgh"[: rng.randint(2, 8)]
        texts = [" ".join(rng.choice(names) for _ in range(rng.randint(5, 40))) for _ in range(3)]
        s = licenses.Scanner([(f"t{k}", t) for k, t in enumerate(texts)], {"a b": "ab"}, 3, 0.1)
        words_ = [w for t in rng.sample(texts, 2) for w in t.split()]
        for _ in range(rng.randint(0, 6)):
            words_[rng.randrange(len(words_))] = rng.choice(names)
        file = [s.ids.get(w.encode(), 0) for w in words_]
        found = list(s.matches(file, 0)) if 0 not in file else None
        got = s.scan(" ".join(words_).encode())["spans"]
        for k in range(3):
            runs, covered = brute_chains(file, s.tokens[k], 3, licenses.STRETCH)
            if found is not None:
                assert sorted((a, b, n) for t, a, b, n in found if t == k) == runs
            own = [c for label, _, _, c in got if label == f"t{k}"]
            assert max(own, default=0) == pytest.approx(covered / s.sizes[k] if covered >= 0.1 * s.sizes[k] else 0)


@pytest.mark.parametrize("name", ["mit", "isc", "bsd-3-clause", "apache-2.0", "gpl-3.0"])
def test_one_changed_word_costs_one_word(name):
    s = licenses.Scanner(licenses.templates(), licenses.PHRASES, 4, 0.8)
    text = (licenses.TEXTS / f"{name}.txt").read_text()
    ws = [w for some in licenses.license_words(text.encode()) for w in some]
    for at in (len(ws) // 2, len(ws) - 9):
        torn = [*ws[:at], b"zzchangedzz", *ws[at + 1 :]]
        spans = [x for x in s.scan(b"some words before " + b" ".join(torn) + b" and after")["spans"] if x[0] == name.split("-")[0] and x[2] - x[1] > 0.9 * len(ws)]
        assert any(a == 3 and b == 2 + len(ws) and c >= 1 - 5 / len(ws) for _, a, b, c in spans)
    twice = s.scan(b" ".join([*ws, b"between", *ws]))["spans"]
    assert sum(b - a + 1 == len(ws) and c == 1.0 for _, a, b, c in twice) >= 2


def test_long_file_is_read_whole():
    s = licenses.Scanner(licenses.templates(), licenses.PHRASES, 4, 0.8)
    text = b"lorem ipsum " * 150_000 + b"MIT License " + b"dolor " * 200_000 + (licenses.TEXTS / "mit.txt").read_bytes()
    got = s.scan(text)
    assert got["n_words"] == plain_base(text.decode())[0] and ("mit", 300_000) in got["places"] and "mit" in {x for x, *_ in got["spans"]}


def test_a_text_that_repeats_a_phrase_takes_time_in_proportion():
    s = licenses.Scanner(licenses.templates(), licenses.PHRASES, 4, 0.8)
    phrase, took = "under the terms of the gnu general public license ", []
    for n in (25_000, 200_000):
        began = time.time()
        got = s.scan((phrase * (n // 9)).encode())
        took.append(time.time() - began)
        assert got["n_words"] == n // 9 * 9 and len(got["places"]) == n // 9 and not got["spans"]
    assert took[1] < 10 and took[1] < 16 * took[0] + 1
    whole = next(t for x, t in licenses.templates() if x == "isc" and len(t) > 400)
    spans = s.scan((phrase * 2000 + whole + " " + phrase * 2000).encode())["spans"]
    assert [x for x, *_ in spans] == ["isc"] and abs(spans[0][1] - 18_000) < 10


def test_templates_left_out_have_no_chain():
    """possible() drops a template only where chaining all its matches finds nothing."""
    rng = random.Random(8)
    kept = dropped = 0
    for _ in range(300):
        words_ = [f"t{k}" for k in range(rng.randint(2, 6))]
        known = [("x", " ".join(rng.choice(words_) for _ in range(rng.randint(3, 12)))) for _ in range(3)]
        s = licenses.Scanner(known, licenses.PHRASES, 3, 0.8)
        file = [s.ids[w] for w in (rng.choice(words_) for _ in range(rng.randint(3, 40))) if w in s.ids]
        if rng.random() < 0.6:
            near = list(rng.choice(s.tokens))
            near[rng.randrange(len(near))] = rng.choice(near)
            file[len(file) // 2 : len(file) // 2] = near
        all_ = s.chains(list(s.matches(file, 0)))
        only = s.possible([(file, 0)])
        assert s.chains(list(s.matches(file, 0, only))) == all_
        kept, dropped = kept + len(only), dropped + 3 - len(only)
    assert kept > 50 and dropped > 50


def test_mix_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = sorted(c.sql(queries.ORACLE_SQL["op5_mixing"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op5_mixing"](spark, SF).collect()) == want


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over


@pytest.mark.parametrize("sources", [{"a": 30, "b": 30, "é": 500, None: 40, "": 3}, {"x": 10}, {"a": 1, "b": 1, "c": 400}])
def test_targets_words_and_bounds(spark, sources):
    rows = [(k * 7 + n, "w " * (1 + (k * 13 + n) % 50), s) for k, (s, m) in enumerate(sources.items()) for n in range(m)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)] + [(None, None, "a"), (-1, "", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS taken", "2 AS class", "3 AS target")).collect()
    assert len(got) == len(rows)
    src = {r[0]: r[2] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = src[r.doc_id] if r.doc_id is not None else "a"
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets({s: n for s, n in sizes.items()})
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 50


@pytest.mark.parametrize("key", [5, None])
def test_rows_of_one_id_are_drawn_one_by_one(spark, key):
    """A source whose rows all share an id, and one whose rows are all equal, come as near to their targets as any."""
    rows = [(key, f"word{k} " * 10, "a") for k in range(1000)] + [(9, "all the same words here", "b")] * 1000 + [(10_000 + k, "w " * 20, "c") for k in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.size] += r.taken
        target[r.size] = r.target
    assert len(got) == len(rows) and set(taken) == {10, 5, 20}
    assert all(abs(taken[s] - target[s]) <= s for s in taken)


def test_mix_of_repeated_rows_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    both = docs.union(docs.limit(40)).union(docs.limit(40)).union(docs.filter("doc_id < 30").selectExpr("1 AS doc_id", "text", "source"))
    c = duckdb.connect()
    c.register("given", both.toPandas())
    c.sql("CREATE VIEW documents AS SELECT * FROM given")
    got = mixing.mix(both).drop("copies")
    assert Counter(c.sql(queries.ORACLE_SQL["op5_mixing"]).fetchall()) == Counter(tuple(r) for r in got.collect())


def test_mixed_rows_repeat_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_rows(docs).collect())
    assert got == Counter({k: n for k, n in copies.items() if n})
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_shards(spark):
    docs = odd_docs(spark).filter("doc_id is null or doc_id not in (-3, -6)")  # texts larger than a shard of this small table
    got = sharding.shard(docs, shards=8).collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.size, r.crc) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(8))
    total = sum(r.size for r in got)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    most = max(r.size for r in got)
    assert all(abs(sum(r.size for r in rs) - total / 8) <= 2 * most for rs in by.values())
    again = {(r.doc_id, r.slot, r.shard) for r in sharding.shard(docs, shards=8).collect()}
    assert again == {(r.doc_id, r.slot, r.shard) for r in got}
    assert sharding.shard(empty_docs(spark)).count() == 0


def shard_sizes(got):
    sums, homes = defaultdict(int), defaultdict(set)
    for r in got:
        sums[r.shard] += r.size
        homes[r.hash].add(r.shard)
    return sums, homes


def test_shards_split_a_huge_group_evenly_and_keep_others_whole(spark):
    rows = [(k, "the very same text " * 5) for k in range(4000)] + [(10_000 + k, f"text number {k % 1500} " * (1 + k % 7)) for k in range(3000)]
    rows += [(20_000 + k, f"a group of middle size, number {k % 6}") for k in range(600)]
    sums, homes = shard_sizes(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).collect())
    mean = sum(sums.values()) / 24
    assert len(sums) == 24 and all(abs(s - mean) < 0.05 * mean for s in sums.values())
    assert sum(len(h) > 1 for h in homes.values()) == 1


@pytest.mark.parametrize("key", [7, None])
def test_shards_of_repeated_rows(spark, key):
    rows = [(key, "again and again")] * 3000 + [(10_000 + k, f"text number {k} " * (1 + k % 3)) for k in range(1500)]
    sums, _ = shard_sizes(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    mean = sum(sums.values()) / 24
    assert len(sums) == 24 and all(abs(s - mean) < 0.05 * mean for s in sums.values())


def test_cuts_are_exact_weighted_medians(spark):
    """Levels of the tree against sorting: each cut divides its node's weight as its goals divide, along the widest dimension."""
    import random

    rng = random.Random(8)
    rows = [(rng.randrange(1 << 20), rng.randrange(1 << 12), rng.randrange(1 << 32), rng.randrange(1, 90)) for _ in range(800)]
    goals = [3.0, 1.0, 2.0, 2.0, 4.0]
    levels = sharding.kd_tree(spark.createDataFrame(rows, "a long, b long, tie long, w long"), ["a", "b"], "w", goals, near=0.0)
    spans = [max(r[k] for r in rows) - min(r[k] for r in rows) for k in (0, 1)]

    def check(own, level, node, n):
        if n == 1:
            return
        cut = levels[level][node]
        widths = [(max(r[k] for r in own) - min(r[k] for r in own)) / spans[k] for k in (0, 1)]
        assert cut.dim == "ab"[widths.index(max(widths))]
        key = lambda r: r["ab".index(cut.dim)] * (1 << 32) + r[2]
        goal = sum(r[3] for r in own) * sum(goals[node : node + n // 2]) / sum(goals[node : node + n])
        below, nearest = 0, abs(goal)
        for r in sorted(own, key=key):
            below += r[3]
            nearest = min(nearest, abs(below - goal))
        left, right = [r for r in own if key(r) < cut.cut], [r for r in own if key(r) >= cut.cut]
        assert abs(sum(r[3] for r in left) - goal) == pytest.approx(nearest)
        check(left, level + 1, cut.left, n // 2)
        check(right, level + 1, cut.right, n - n // 2)

    check(rows, 0, 0, len(goals))


def test_few_documents(spark):
    got = sharding.shard(spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(0 <= r.shard < 24 and r.slot >= 0 for r in got)

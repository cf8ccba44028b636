"""Periodic runs, packing and phrases against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from checks.compare import compare
from veilspark.llm import packing, phrases, quality, runs, weak
from veilspark.llm.common import table, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, n int, runs int, lang_ int"
LONG = "word " * 40_000 + "x" * 50_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, a very long text, repeated rows, and columns named as inner ones."""
    rows = [
        (None, "no id here", "en"), (1, None, "en"), (2, "", None), (3, "   \n\t ", "de"), (4, LONG, "en"),
        (5, "one two three four five six seven", "en"), (5, "one two three four five six seven", "en"),
        (6, "one two three four five six seven", "fr"), (7, "é 漢 😀", None), (8, "two words", "en"), (9, "two words", "en"),
    ]
    return spark.createDataFrame([(i, t, g, "s", 0, 7, 8, 9, 1) for i, t, g in rows], DOCS)


# --- 11 -----------------------------------------------------------------------------------------
def brute_runs(words, least=12):
    """Every stretch w[i] == w[i + q], from its first place to its last, under its least q."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_row(words):
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (len(found), s, n, q, 1000 * n // q if found else None, listed, kept)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_all_documents(spark, folder):
    docs = {r.doc_id: words_of(r.text) for r in table(spark, folder, "documents").collect()}
    got = {r[0]: tuple(r)[1:] for r in runs.op11_runs(spark, folder).collect()}
    assert set(got) == set(docs) and sum(r[0] > 0 for r in got.values()) > 5
    short = {i: w for i, w in docs.items() if len(w) < 3000}  # brute force is quadratic
    assert len(short) > len(docs) * 0.9
    assert {i: got[i] for i in short} == {i: run_row(planted(i, w)) for i, w in short.items()}


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_made_words():
    """Small alphabets, repeats in repeats, and words rich in runs, several texts in one slice."""
    rng = random.Random(7)

    def made():
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 5, 20])) for _ in range(rng.randrange(160))]
        for _ in range(rng.randrange(4) if words else 0):
            a, p = rng.randrange(len(words)), rng.randrange(1, 1 + max(1, len(words) // 3))
            for i in range(a, min(len(words), a + rng.randrange(1, 1 + len(words)))):
                words[i] = words[a + (i - a) % p]
        return words

    for _ in range(60):
        texts = [made() for _ in range(rng.randrange(1, 8))] + [fibonacci(200), ([0, 1] * 7 + [0]) * 3 + [0, 1, 0, 1, 0] * 4]
        starts = np.cumsum([0, *map(len, texts)])
        got = runs.find_runs_in(np.array([w for t in texts for w in t], np.int64), starts)
        assert list(map(tuple, got.tolist())) == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_wavelet_tree_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 200):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        low = rng.integers(0, n + 1, 300)
        high = np.minimum(n, low + rng.integers(0, n + 1, 300))
        least = rng.integers(0, n + 2, 300)
        want = [min((v for v in values[a:b] if v >= x), default=n) for a, b, x in zip(low, high, least)]
        assert tree.successor(low, high, least).tolist() == want


def test_runs_on_odd_rows(spark, odd):
    got = sorted(runs.periodic_runs(odd).collect(), key=str)
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert [(r.start, r.length, r.period) for r in by_id[4].runs] == [(0, 40_000, 1)]
    assert by_id[4].collapsed == "word " + "x" * 50_000 and by_id[4].n_words == 40_001
    assert [(by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) for i in (1, 2, 3, 7)] == [
        (0, [], ""), (0, [], ""), (0, [], ""), (3, [], "é 漢 😀")
    ]
    assert by_id[None].collapsed == "no id here"
    assert runs.periodic_runs(odd.filter("false")).collect() == []
    assert len(runs.with_planted_runs(odd).collect()) == odd.count()
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, least=5)


# --- 12 -----------------------------------------------------------------------------------------
def cut_by_library(texts, size=1024):
    """(id, piece) -> (start, length, checksum), with ids from the tokenizers library."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = {}
    for i, text in texts.items():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % size or size
        cuts = [0, first, *range(first + size, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def best_fit_one_by_one(lengths, size=1024):
    gaps = []
    for length in sorted(lengths, reverse=True):
        able = [g for g in gaps if g >= length]
        if able:
            gaps.remove(min(able))
        gaps.append((min(able) if able else size) - length)
    return len(gaps)


def check_places(rows, size=1024):
    """Every sequence is filled from 0 on without a gap; returns how many there are."""
    by_sequence = {}
    for sequence, offset, length in rows:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


def test_packing_of_all_documents(spark, folder):
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    got = packing.op12_packing(spark, folder).collect()
    want = cut_by_library(texts)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    n = check_places((r.sequence_id, r.offset, r.length) for r in got)
    assert -(-sum(r.length for r in got) // 1024) <= n <= best_fit_one_by_one([r.length for r in got])


def test_plans_lose_nothing_and_fill_what_can_be_filled():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randrange(1, 60)
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(0, 60))]
        counts = [lengths.count(x) for x in range(size + 1)]
        plan = packing.plan_packing(counts)
        used = [0] * (size + 1)
        for pattern, times in plan:
            assert times > 0 and sum(x * n for x, n in pattern.items()) <= size
            for x, n in pattern.items():
                used[x] += n * times
        assert used == counts
        assert sum(t for _, t in plan) <= best_fit_one_by_one(lengths, size)
    # complements of one, two and three lengths, each as often as the counts allow
    assert sorted(t for _, t in packing.plan_packing(np.bincount([700] * 5 + [324] * 5, minlength=1025))) == [5]
    assert sum(t for _, t in packing.plan_packing(np.bincount([1000] * 8 + [10, 14] * 8, minlength=1025))) == 8
    assert sum(t for _, t in packing.plan_packing(np.bincount([900] * 8 + [20, 44, 60] * 8, minlength=1025))) == 8


def test_sum_index_counts_sums():
    rng = random.Random(3)
    counts = np.array([0] + [rng.randrange(3) for _ in range(30)])
    index = packing.SumIndex(counts)
    while index.one.any():
        fresh = packing.SumIndex(index.left)
        assert (index.one == fresh.one).all() and (index.two == fresh.two).all() and (index.three == fresh.three).all()
        for gap in range(1, 31):
            found = index.exact(Counter(), gap)
            assert found is None or (sum(found) == gap and all(index.left[x] >= found.count(x) for x in found))
        x = rng.choice(np.flatnonzero(index.one).tolist())
        index.take(Counter([x]), 1)


def test_packing_in_buckets_and_on_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = [(i, 1 + (i * i) % 90 if i % 3 else 40, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, len int, `offset` string")
    got = packing.pack(df, "len", 100).collect()
    assert sorted((r.k, r.len) for r in got) == [(k, n) for k, n, _ in rows]
    assert check_places(((r.sequence_id, r.offset, r.len) for r in got), 100) <= best_fit_one_by_one([n for _, n, _ in rows], 100)
    cut = packing.cut_documents(odd)
    placed = packing.pack(cut).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    want = cut_by_library(texts)
    assert {(r.doc_id, r.piece): (r.start, r.length, zlib.crc32(r.ids)) for r in placed} == want
    assert len(placed) == len(want) + 1  # document 5 is there twice
    check_places((r.sequence_id, r.offset, r.length) for r in placed)
    whole = packing.sequences(packing.pack(cut)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4096 for r in whole)
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in placed)
    assert packing.pack(cut.filter("false")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, "len", 50)


def test_packing_of_texts_the_fast_engine_gives_up(spark):
    texts = {1: "\n" * 1_200_000 + "a", 2: "a<|endoftext|>b", 3: "x" * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.piece): (r.start, r.length, zlib.crc32(r.ids)) for r in packing.cut_documents(df).collect()}
    assert got == cut_by_library(texts)


# --- 13 -----------------------------------------------------------------------------------------
def brute_phrases(rows, least, longest, top, covered=50):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, *words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    found = {key: a for key, a in counts.items() if len(key) > 2 and a >= least}
    out = {}
    for key, a in found.items():
        lang, *words = key
        inside = any(
            other[0] == lang and len(other) > len(key) and 100 * b >= covered * a
            and any(other[i : i + len(words)] == tuple(words) for i in range(1, len(other)))
            for other, b in found.items()
        )
        if not inside:
            cuts = [(counts[lang, *words[:k]], counts[lang, *words[k:]]) for k in range(1, len(words))]
            score, k = min((10**6 * a * a // (l * r), k) for k, (l, r) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), *cuts[k]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, sizes[lang], -score)
        for lang, group in out.items()
        for i, (score, a, p, l, r) in enumerate(sorted(group)[:top])
    )


def test_phrases_of_all_documents(spark, folder, duck):
    same, message, _ = compare(spark, duck, folder, "op13", phrases.op13_phrases, phrases.SQL)
    assert same, message


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_phrases_against_brute_force(spark, monkeypatch, broadcast):
    """With groups sent to all tasks and joined by a shuffle; several lengths, limits and buckets of numbers."""
    monkeypatch.setattr(phrases, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(phrases, "NUMBERED_ROWS", 7)
    monkeypatch.setattr(phrases, "_FLUSH", 50)
    rng = random.Random(4)
    vocabulary = ["the", "The", "a", "of", "\u00e9t\u00e9", "\U0001f600", "x" * 50, "New", "york", "city"]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(30))
        words += ["new", "York", "city"] * (i % 3)
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for w in words)))
    rows += [("en", None), (None, ""), ("fr", " . ,"), ("en", "the of " * 3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for least, longest, top in ((10, 3, 2000), (3, 4, 5), (1, 2, 10)):
        got = sorted(map(tuple, phrases.phrase_collocations(df, least=least, longest=longest, top=top).collect()))
        assert got == brute_phrases(rows, least, longest, top)


def test_phrases_by_shuffle_move_packets(spark, monkeypatch, tmp_path):
    """More groups than may be broadcast: a shuffle moves packets of keys, not a row per place of a word."""
    monkeypatch.setattr(phrases, "BROADCAST_GROUPS", 0)
    moved, written = [], phrases.written

    def seen(df, name):
        out = written(df, name)
        moved.append((name, out.count()))
        return out

    monkeypatch.setattr(phrases, "written", seen)
    exploded = []
    monkeypatch.setattr(phrases.F, "posexplode", lambda *a: exploded.append(a) or pytest.fail("a row per place"))
    rows = [("en", "one two three four five six seven eight nine ten " * 400)] * 30
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, phrases.phrase_collocations(df).collect()))
    assert got == brute_phrases(rows, 10, 3, 2000)
    assert all(n <= 30 for _, n in moved), moved
    assert not exploded


def test_keys_of_two_words_are_found(spark, monkeypatch):
    """A hash that gives different words one key must not merge their counts: another salt is taken."""
    real, salts = phrases._word_counts, []

    def clashing(src, salt, least):
        salts.append(salt)
        rows = real(src, salt, least)
        return rows.withColumn("what", phrases.F.lit(2)) if salt == 1 else rows

    monkeypatch.setattr(phrases, "_word_counts", clashing)
    rows = [("en", "new york " * 20)]
    got = phrases.phrase_collocations(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert salts == [1, 2] and sorted(map(tuple, got)) == brute_phrases(rows, 10, 3, 2000)
    held = phrases._Words()
    words = phrases.pa.array(["a", "b", "a"], phrases.pa.large_string())
    held.add(np.array([7, 7, 9], np.uint64), np.zeros(3, int), words, np.array([2, 3, 4]))
    assert [x.tolist() for x in held.together()[::3]] == [[7, 7, 9], [2, 3, 4]]


def test_phrases_on_odd_rows(spark, odd):
    assert phrases.phrase_collocations(odd.filter("false")).collect() == []
    assert phrases.phrase_collocations(odd.filter("doc_id = 8")).collect() == []
    got = sorted(map(tuple, phrases.phrase_collocations(odd, least=2).collect()))
    assert got == brute_phrases([(r.lang, r.text) for r in odd.collect()], 2, 3, 2000)


def test_hot_scores_are_exact(spark):
    """Products of counts pass 64 bits: 10**6 * a * a with a in the ten thousands of millions."""
    big = 30_000_000_011
    made = spark.sql(f"SELECT CAST({big}L AS bigint) AS n, array(CAST({big + 7}L AS bigint)) AS heads, array(CAST({big + 9}L AS bigint)) AS tails")
    got = made.withColumn("k", phrases.F.lit(0)).selectExpr(f"{phrases.CUT}.score AS s").first().s
    assert got == 10**6 * big * big // ((big + 7) * (big + 9))


# --- 2 ------------------------------------------------------------------------------------------
def plain_posteriors(counts, patterns, rounds=50):
    """Expectation-maximisation written out with products of probabilities instead of logarithms."""
    belief = {p: 0.05 if "-" in p else 0.95 if "+" in p else 0.5 for p in counts}
    for _ in range(rounds):
        good = 1 + sum(n * belief[p] for p, n in counts.items())
        bad = 1 + sum(n * (1 - belief[p]) for p, n in counts.items())
        rate = {}
        for i in range(len(next(iter(counts)))):
            for mark, weights in (("+", (3.0, 1.0)), ("-", (1.0, 3.0))):
                rate[i, mark] = [
                    weights[0] + sum(n * belief[p] for p, n in counts.items() if p[i] == mark),
                    weights[1] + sum(n * (1 - belief[p]) for p, n in counts.items() if p[i] == mark),
                ]

        def posterior(p):
            x, y = good, bad
            for i, mark in enumerate(p):
                if mark != "0":
                    x *= rate[i, mark][0] / (rate[i, "+"][0] + rate[i, "-"][0])
                    y *= rate[i, mark][1] / (rate[i, "+"][1] + rate[i, "-"][1])
            return x / (x + y)

        belief = {p: posterior(p) for p in counts}
    return {p: posterior(p) for p in patterns}


def test_weak_labels_against_plain_estimates_and_unseen_patterns(spark, folder):
    docs = table(spark, folder, "documents")
    some = docs.orderBy("doc_id").limit(5)
    model = quality.train(some)
    scored = quality.score_quality(docs, model).collect()  # nearly all patterns are new to the model
    counts = Counter(r.votes for r in quality.score_quality(some, model).collect())
    assert len(scored) == docs.count() and {r.votes for r in scored} - set(counts)
    want = plain_posteriors(counts, {r.votes for r in scored})
    assert all(abs(r.weak_label - want[r.votes]) < 1e-9 for r in scored)
    empty = quality.train(docs.filter("false"))
    assert {r.score for r in quality.score_quality(some, empty).collect()} == {0.0}
    assert weak.reliabilities({}, also=[("", "+")]) == {("", "+"): weak.majority("+")}

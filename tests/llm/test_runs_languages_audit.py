"""Periodic runs, language identification and the filter audit beside brute force and SQL."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from loadloom.llm import filter_audit, language_id, queries, tandem_runs  # noqa: E402

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def brute_runs(w, least):
    """Every stretch of equal words q apart, of at least two q and ``least`` words, that no smaller period has."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q) and all(any(w[a] != w[a + p] for a in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_symbols(letters):
    rng = random.Random(letters)
    for _ in range(250):
        w = [rng.randrange(letters) for _ in range(rng.randint(1, 50))]
        if rng.random() < 0.4:
            s, p = rng.randrange(len(w)), rng.randint(1, 9)
            w = [w[i] if i < s + p else w[s + (i - s) % p] for i in range(len(w))]
        got = tandem_runs.runs_of(np.array([*w, 99]))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == brute_runs(w, 0)


def test_covering_squares_are_squares():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.append(rng.integers(0, 2, 40), 9)
        s = tandem_runs.Suffixes(x)
        for place, root in zip(*tandem_runs.leftmost_covering(s), strict=True):
            assert (x[place : place + root] == x[place + root : place + 2 * root]).all()
        # Each LZ block but the last is as long as its earlier occurrence allows.
        edge, text = s.blocks().tolist(), x.tolist()
        for a, b in itertools.pairwise(edge):
            earlier = [j for j in range(a) if text[j : j + b - a] == text[a:b]]
            assert b - a == 1 or earlier
            assert not any(text[j : j + b - a + 1] == text[a : b + 1] for j in range(a)) or b == len(text)


def test_runs_of_texts_in_slices(monkeypatch):
    rng = random.Random(7)
    for _ in range(60):
        texts = [" \n".join(f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.randint(0, 70))) for _ in range(rng.randint(1, 6))]
        for text, (runs, collapsed) in zip(texts, tandem_runs.analyse(texts), strict=True):
            w = text.split()
            want = brute_runs(w, 12)
            assert [tuple(r) for r in runs.tolist()] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    long = tandem_runs.analyse(["x y " * 100_000, "a " * 50_001])
    assert long[0][0].tolist() == [[0, 200_000, 2]] and long[1][0].tolist() == [[0, 50_001, 1]] and long[1][1] == "a"


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, " \t", 7), (4, "a b " * 6, 8), (4, "a b " * 6, 8), (None, "é " * 13, 9), (5, "a b " * 12, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("collapsed", F.lit("own"))
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in tandem_runs.collapse(df).collect()]
    assert sorted(got, key=str) == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 12, 2)], "a b"), (4, [(0, 12, 2)], "a b"), (None, [(0, 13, 1)], "é"), (5, [(0, 12, 1)], "a b")], key=str)
    assert tandem_runs.collapse(df.limit(0)).count() == 0 and "text" not in tandem_runs.collapse(df, carry=False).columns


@tables
def test_op11(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op11_periodic_runs"](spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        w = docs[r.doc_id].encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        if len(w) > 1500:
            continue
        runs = brute_runs(w, 12)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        text = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(text).hexdigest()
    assert planted > 5


def brute_labels(s, price):
    best, back, own = s[0].astype(int), [], np.arange(s.shape[1])
    for row in s[1:]:
        least = best.max() - price
        stay = best >= least
        back.append(np.where(stay, own, best.argmax()))
        best = np.where(stay, best, least) + row
    k = int(best.argmax())
    out = [k]
    for b in back[::-1]:
        k = int(b[k])
        out.append(k)
    return out[::-1]


def test_viterbi_in_blocks(monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 50)
    rng = np.random.default_rng(0)
    for _ in range(200):
        edge = np.concatenate(([0], np.cumsum(rng.integers(0, 40, rng.integers(1, 6)))))
        s, price = rng.integers(-5, 6, (edge[-1], rng.integers(1, 5))), int(rng.integers(1, 9))
        got = language_id.viterbi(s, edge, price, int(rng.choice([1, 3, 8, 64])))
        for a, b in itertools.pairwise(edge):
            assert a == b or got[a:b].tolist() == brute_labels(s[a:b], price)
            # No labelling has a greater total.
            if 0 < b - a <= 5:
                worth = lambda c: sum(s[a + i, x] for i, x in enumerate(c)) - price * sum(x != y for x, y in itertools.pairwise(c))
                assert worth(got[a:b].tolist()) == max(map(worth, itertools.product(range(s.shape[1]), repeat=int(b - a))))


def test_features_of_words():
    words = ["ab", "é", "привет", "abcde"]
    owner, bucket, script = language_id.features(words)
    # Of a word of n signs between two edges: itself, n signs, n + 1 pairs, n triples, n - 1 fours.
    assert np.bincount(owner).tolist() == [1 + n + n + 1 + n + n - 1 for n in map(len, words)]
    assert script.tolist() == [0, 0, 2, 0] and 0 <= bucket.min() and bucket.max() < language_id.BUCKETS
    alone = sorted(language_id.features(["привет"])[1].tolist())
    assert alone == sorted(bucket[owner == 2].tolist())
    assert language_id.words_of("Don't 3x ½ नमस्ते 漢字漢字漢字 ²") == ["don", "t", "x", "नमस्ते", "漢字漢字", "漢字"]


TONGUES = {"aa": "ta ri no sum", "bb": "lof gu wek dra", "cc": "да но рит ка"}


def tongue(rng, name, n):
    parts = TONGUES[name].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(2)
    rows = [(i, tongue(rng, k, rng.randint(5, 60)), k) for i in range(200) for k in [rng.choice(list(TONGUES))]]
    df = spark.createDataFrame([*rows, (900, None, "zz"), (901, "ta", None)], "doc_id long, text string, lang string")
    return language_id.fit(df)


def test_languages_of_spans(spark, taught):
    rng = random.Random(3)
    assert taught.languages == ("aa", "bb", "cc")
    a, b, c = (tongue(rng, k, 30) for k in ("aa", "bb", "cc"))
    rows = [(1, f"{a}. {b}! 12 {c}"), (2, a), (3, None), (4, ""), (5, "12 ½ ²--"), (6, b * 3000), (7, f"{b} no {b}"), (None, c), (2, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("spans", F.lit(1))
    got = language_id.predict(df, taught, spans=True).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r for r in got}
    text = rows[0][1]
    assert [(text[s.start : s.stop], s.lang) for s in found[1].spans] == [(a, "aa"), (b, "bb"), (c, "cc")]
    assert [found[i].lang_pred for i in (2, 3, 4, 5, 6, 7, None)] == ["aa", "und", "und", "und", "bb", "bb", "cc"]
    assert found[3].score == 0 and found[3].spans == [] and len(found[7].spans) == 1 and len(found[6].spans) == 1
    assert language_id.predict(df.limit(0), taught).count() == 0


def test_languages_without_lessons(spark, taught, monkeypatch):
    df = spark.createDataFrame([(1, "ta ri", "aa"), (2, "lof", "bb")], "doc_id long, text string, lang string")
    none = language_id.fit(df.limit(0))
    assert [(r.lang_pred, r.score) for r in language_id.predict(df, none).collect()] == [("und", 0.0)] * 2
    one = language_id.fit(df.limit(1))
    assert {r.lang_pred for r in language_id.predict(df, one).collect()} == {"aa"}
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="2 languages"):
        language_id.fit(df)


def test_scores_do_not_depend_on_slices(spark, taught, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, tongue(rng, "aa", 40) + " " + tongue(rng, "bb", rng.randint(1, 80))) for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, language_id.predict(df.coalesce(1), taught).collect()))
    assert want == sorted(map(tuple, language_id.predict(df.repartition(7), taught).collect()))
    lexicon = language_id.Lexicon(taught)
    monkeypatch.setattr(language_id, "CACHED", 10)
    for i, text, lang, score in want:
        assert language_id.label([language_id.words_of(text)], lexicon)[:2] == ([lang], [score])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_op12_on_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op12_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    held = [r for r in docs if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.98


def brute_audit(docs, labels):
    """Each order simulated row by row."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, removed_in_all = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_in_all[part, f] = removed_in_all.get((part, f), 0) + len(now)
                out[part, order, step] = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in gone + now + left), sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows_of(df):
    got = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in got}
    assert len(out) == len(got)
    return out


def test_filter_audit(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]

    def text():
        w = [rng.choice(vocabulary[: rng.choice([5, 80, 400])]) for _ in range(rng.choice([3, 150, 250]))]
        return " ".join(x.upper() if rng.random() < rng.choice([0, 0, 0.3]) else x for x in w) + rng.choice(["", "", " #", "\t|x"])

    texts = [text() for _ in range(40)] + ["", None, " \n", "é" * 300]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    docs += [(7, docs[7][1], "de"), docs[8], docs[8], (None, texts[0], "en"), (None, texts[0], "en"), (9999, "x " * 100_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (12345, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"mask": F.lit("own"), "n": F.lit(1), "digest": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("own"))
    assert rows_of(filter_audit.audit(d.repartition(5), lab)) == brute_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert rows_of(filter_audit.audit(d, lab.limit(0))) == brute_audit(docs, [])


@tables
def test_op13(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert rows_of(queries.queries()["op13_filter_audit"](spark, SF)) == brute_audit(docs, labels)

"""Each registered query of the operators, over the whole smallest tables, beside SQL or a plain restatement."""

import collections
import hashlib
import html
import os
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import test_training_operators as plain  # noqa: E402

from loadloom.llm import common, exact_dedup, html_text, jaccard_join, license_scan, packing, queries, toxicity, url_filters, word_bpe  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def texts_of(documents):
    return [(i, r.text) for i, r in documents.items()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_beside_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    got = sorted(tuple(map(str, (r[c] for c in names))) for r in run(spark, name))
    assert got == sorted(tuple(map(str, (dict(zip(want.columns, r))[c] for c in names))) for r in want.fetchall())


def test_op2(spark, documents):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op2_ngram_jaccard")} == plain.brute_components(texts_of(documents))


def test_op3(spark, documents):
    got = run(spark, "op3_quality_rules")
    assert len(got) == len(documents)
    for r in got:
        t = documents[r.doc_id].text
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.brute_rules(t) and r.kept == plain.brute_kept(t or "")


def test_op5(spark, pages):
    weights, constant = url_filters.model(spark)
    got = run(spark, "op5_url_filters")
    assert len(got) == len(pages)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r.page_id].url or "")
        host, path = (m[1].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        at = plain.brute_slots(host, path)
        logit = sum(weights[k] for k in at) / max(1, len(at)) ** 0.5 + constant
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if logit >= 0 else "allow"))


def test_op6(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(plain.BYTE)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts_of(documents)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, "op6_packing"):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, most in [(v, len(ids[i])) for i, v in pieces.items()] + [(v, None) for v in sequences.values()]:
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        size = sum(spans[-1])
        assert size == most if most else size == 2048 or size < 2048 and size & (size - 1) == 0
    assert set(pieces) == set(ids)


def test_op7(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(plain.WORDS)
    got = run(spark, "op7_word_bpe")
    assert len(got) == len(documents)
    for r in got:
        ids = tok.encode(documents[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8(spark, pages):
    got = run(spark, "op8_html_extraction")
    assert len(got) == len(pages)
    for r in got:
        # These pages hold their text in one article of headings and paragraphs.
        m = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id].html or "")
        blocks = re.split(r"</?(?:p|h1|div)\b[^>]*>", m[1]) if m else []
        want = [x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op9(spark, documents):
    texts = [r.text for r in documents.values()]
    got = {r.doc_id: r for r in run(spark, "op9_license_scan")}
    own, given = {}, {}
    for i, r in documents.items():
        first = (r.text or "").split("\n")[0]
        name = f"LICENSE.{i}" if re.search(queries.LICENSE_LINE.removeprefix("(?i)"), first, re.I) else f"{i}.txt"
        path = "/".join(x for x in (r.source, r.lang, str(i // 1000), name) if x is not None)
        s, licence = plain.brute_license(texts, r.text or "", name.startswith("LICENSE"))
        assert got[i].path == path
        if s >= license_scan.THRESHOLD:
            own[i] = licence
            if name.startswith("LICENSE"):
                at = path.rpartition("/")[0]
                given[at] = min(given.get(at, (0, "")), (-s, licence))
    for i in documents:
        at = got[i].path.rpartition("/")[0]
        while at and at not in given:
            at = at.rpartition("/")[0]
        want = own.get(i) or given.get(at, (0, None))[1]
        assert got[i].license == want and (got[i].inherited_from == at if want and i not in own else got[i].inherited_from is None)
    assert own


def test_op10(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op10_toxicity")}
    assert len(got) == len(documents)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by_text = collections.defaultdict(set)
    for i, r in got.items():
        by_text[documents[i].text].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())


def test_op10_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op10_toxicity"](spark, sf).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and got[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_shared_dir_without_a_setting():
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    session = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="local[2]", applicationId="test-app", getConf=lambda: conf))
    found = common.shared_dir(session)
    assert os.path.isdir(found) and common.shared_dir(session) == found
    os.rmdir(found)


def test_tables_are_deleted(spark):
    shelf = common.Shelf(spark)
    shelf.put(spark.range(3), "shelf")
    path = shelf.paths[0]
    assert spark.read.parquet(path).count() == 3
    shelf.clear()
    assert not os.path.exists(path.removeprefix("file:"))


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6)], "doc_id long, text string, gone string, node long")
    assert jaccard_join.dedup(df).collect() == df.where("doc_id = 1").collect()
    assert jaccard_join.dedup(df.limit(0)).count() == 0 and exact_dedup.dedup(df.limit(0)).count() == 0
    odd = df.select("doc_id", "text", F.lit(1).alias("length"), F.lit(2).alias("start"), F.lit("z").alias("n_tokens"))
    assert {r.doc_id for r in packing.pack(odd, plain.BYTE).collect()} == {1, 2}
    assert {r.n_tokens for r in word_bpe.encode_decode(odd, plain.WORDS).collect()} == {6}
    assert word_bpe.encode_decode(odd.limit(0), plain.WORDS).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    none = df.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert html_text.main_text("<p>" + "long " * 400_000).count("long") == 400_000


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, and repeated ids, go through all stages."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, text, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, "en", "s", 0), (3, text + " more", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1}

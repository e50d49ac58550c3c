"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import pytest

from quillon.llm import contamination, fingerprint, jaccard, langmodel, lines, mixing, secrets, tokens, toxicity, urls
from quillon.llm import queries as Q

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 20_000
ROWS = [
    (1, None, "a", "b"), (2, "", "a", "b"), (3, "same words here and there again", "a", None), (4, "same words here and there again", None, "b"),
    (4, "same words here and there again", None, "b"), (None, "no id for this text at all", "a", "b"), (5, LONG, "a", "b"), (6, " \n\t ", "a", "b"), (7, "é", "a", "b"),
]
#: Names that operators use inside.
SCHEMA = "doc_id long, text string, key string, token string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.collect())


EVERY = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_tokens(spark, docs, none):
    read = lambda d: tokens.read_tokens(spark, tokens.write_tokens(d, Q.tokenizer_path(), chunk_ids=100, block=64))
    got = read(docs).orderBy("start").collect()
    assert ids(read(docs)) == EVERY and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and {r.n_tokens for r in got if r.doc_id in (1, 2, 6)} == {1}
    assert read(none).count() == 0


def test_planes_round_trip():
    import numpy as np

    for n in (0, 1, 63, 64, 1000):
        for top in (1, 200, 50_000, 2**32 - 1):
            v = np.random.default_rng(n).integers(0, top, n, endpoint=True).astype("<u4")
            for bits in (False, True):
                p = tokens.encode_planes(v, block=64, bits=bits)
                assert (tokens.decode_planes(p) == v).all() and (tokens.decode_planes(p, n // 3, n // 2) == v[n // 3 : n // 2]).all()


def test_lines(docs, none):
    got = {r.doc_id: r for r in lines.dedup_lines(docs, min_chars=5, min_docs=2).collect() if r.doc_id != 4}
    assert got[3].n_dropped == 1 and got[3].kept == "" and got[1].n_lines == 1 and got[6].n_lines == 2
    assert [r.kept for r in lines.dedup_lines(docs, min_chars=5, min_docs=2).where("doc_id = 4").collect()] == ["same words here and there again"] * 2
    assert lines.dedup_lines(none).count() == 0


def test_levelled_runs(spark):
    runs = lines.LineRuns(spark, fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b, 0, b), (100, 0, b)], "hi long, lo long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = {r.hi: (r.n_docs, r.last_doc) for r in runs.merged().collect()}
    assert merged == {100: (5, 4)} | {b: (1, b) for b in range(5)}
    #: The anti-join decides: each hash is in one run, and only the common one has additions.
    own = [r.hi for run in runs.runs() for r in run.collect()]
    assert sorted(own) == [0, 1, 2, 3, 4, 100] and [(r.hi, r.n_docs, r.last_doc) for r in runs.additions().collect()] == [(100, 4, 4)]
    plan = runs.runs()[0].join(runs.runs()[1].hint("merge"), ["hi", "lo"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.drop()
    assert not runs.runs() and runs.merged().count() == 0


def test_language_model(docs, none):
    got = langmodel.score_documents(docs, docs.doc_id > 2)
    assert ids(got) == EVERY and all(r.score <= 0 for r in got.collect())
    assert langmodel.score_documents(docs, docs.doc_id > 99).where("train_tokens = 0").count() == len(ROWS)
    assert langmodel.score_documents(none, none.doc_id > 2).count() == 0


def test_jaccard(docs, none):
    got = jaccard.similarity_components(docs)
    assert ids(got) == EVERY
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert of[4] == (2, 3) and of[1] == (0, 1) and of[6] == (0, 6) and of[7] == (1, 7) and of[None][1] is None
    assert jaccard.similarity_components(none).count() == 0


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(10, "Same words, HERE and there"), (11, "too short"), (12, None), (13, "Same words, HERE and there")], "item_id long, text string")
    got = contamination.find_contained(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(d, i) for d in (3,) for i in (10, 13)] + [(4, 10)] * 2 + [(4, 13)] * 2 and all(r.containment == 1 for r in got)
    kept = contamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert contamination.find_contained(none, items).count() == 0 and contamination.find_contained(docs, items.limit(0)).count() == 0
    blocks = contamination.find_contained(docs, items, block_items=1)
    assert blocks.count() == 6


def test_least_hits_bound():
    for size in (5, 30, 60, 400):
        need = contamination.least_hits(size, min(size, 16), 0.8, 1e-6)
        assert 1 <= need <= size


def test_fingerprints(docs, none):
    got = fingerprint.with_successor(docs, ranges=4)
    assert ids(got) == EVERY
    row = {r.doc_id: r for r in got.collect()}
    assert row[1].fingerprint == "" and row[1].near_edited == 1.0 and row[3].near_next == 1.0
    assert fingerprint.with_successor(none).count() == 0 and fingerprint.with_successor(docs.limit(1)).count() == 1
    assert ids(fingerprint.fingerprint_documents(docs)) == EVERY


def test_sketches_merge():
    import numpy as np

    from quillon.llm.text import mix

    h = mix(np.arange(3000, dtype=np.uint64))
    a, b = fingerprint.sketch_of(h[:2000], 64), fingerprint.sketch_of(h[1000:], 64)
    assert (fingerprint.merge(a, b, 64) == fingerprint.sketch_of(h, 64)).all()
    assert abs(fingerprint.resemblance(a, b, 64) - 1 / 3) < 0.2 and abs(fingerprint.containment(a, b, 64) - 0.5) < 0.25
    assert abs(fingerprint.distinct_estimate(a, 64) - 2000) < 800 and (fingerprint.from_text(fingerprint.to_text(a)) == a).all()


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (5, 0), (1, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, min_rows=1, least=0.0))
    assert ids(got) == EVERY and set(docs.columns) < set(got.columns)
    of = {r.doc_id: r.tox_score for r in got.collect()}
    assert of[4] >= of[5]
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("tox_score < 0.01").count() == len(ROWS)
    assert toxicity.score(none, toxicity.fit(docs, labels)).count() == 0


def test_urls(spark):
    rows = [(1, None, "a"), (2, "no scheme", "b"), (3, "http://", "c"), (4, "HTTP://A.Com/en/7#x", "d"), (4, "HTTP://A.Com/en/7#x", "d"), (None, "x://b.net?q", "e"), (6, "x://h/" + "a/" * 50, "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge_urls(pages, Q.RULES)
    assert got.count() == len(rows)
    of = {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in got.collect()}
    assert of[1] == ("", "", None, "allow") and of[4] == ("a.com", "/en/7", "com/en/", "block") and of[None][:2] == ("b.net", "")
    assert urls.judge_urls(pages.limit(0), Q.RULES).count() == 0 and urls.judge_urls(pages, []).where("url_verdict = 'block'").count() == 0


def test_url_tree_rejects_by_purity(spark):
    rows = [(i, f"http://h.org/spam/{i}") for i in range(60)] + [(100 + i, f"http://h.org/good/page{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [urls.Rule("h.org", f"/spam/{i}", "block") for i in range(10, 40)] + [urls.Rule("h.org", f"/good/page{i}", "allow") for i in range(10, 40)]
    got = {r.page_id: (r.url_verdict, r.url_template) for r in urls.judge_urls(pages, rules).collect()}
    assert got[50] == ("block", "h.org/spam/{n}") and got[150] == ("allow", "h.org/good/*")


def test_secret_ledger_is_incremental(spark):
    v1 = [("a", 1, "password = hunter22"), ("b", 1, "password = hunter22"), ("c", 1, None), (None, None, "x"), ("a", 1, "password = hunter22")]
    v2 = [("a", 2, "key AKIA" + "Z" * 16), ("b", 1, "password = hunter22")]
    make = lambda rows: secrets.history_of(spark.createDataFrame(rows, "p string, v int, text string"), "p", "text", "v")
    ledger = secrets.SecretLedger(spark)
    ledger.scan(make(v1))
    ledger.scan(make(v2))
    sizes = [spark.read.parquet(p).select("blob").distinct().count() for p in ledger.parts]
    assert sizes == [3, 1]
    got = sorted((r.path or "", r.version or 0, [(s.kind, s.start, s.stop) for s in r.spans]) for r in ledger.report(make(v1 + v2)).collect())
    assert got[0] == ("", 0, []) and got[-1][0] == "c" and [g[2] for g in got if g[0] == "b"] == [[("assign", 0, 19)]] * 2
    newer = secrets.SecretLedger(spark, ledger.root, (*secrets.BASE, secrets.SecretRule("hex", r"[0-9a-f]{30,}", version=2))).reopen(ledger.parts)
    newer.scan(make(v1))
    assert [r.rules for r in spark.read.parquet(newer.parts[-1]).collect()] == [["hex@2"]] * spark.read.parquet(newer.parts[-1]).count()
    assert secrets.SecretLedger(spark).report(make([])).count() == 0


def test_mixing(spark, docs, none):
    labelled = spark.createDataFrame([(3, "x"), (5, "y"), (None, "x")], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"x": 0.5, "y": 0.5}, buckets=64)
    assert ids(got) == EVERY and set(docs.columns) < set(got.columns)
    assert mixing.mix(none, labelled, {"x": 1.0}, buckets=64).count() == 0
    assert mixing.mix(docs, labelled.limit(0), {"x": 0.5, "y": 0.5}, buckets=64).where("abs(mix_posteriors[0] - 0.5) < 1e-9").count() == len(ROWS)
    again = mixing.repeated(mixing.mix(docs, labelled, {"x": 0.5, "y": 0.5}, least=1.0, budget=1.5, buckets=64), docs.columns)
    assert again.columns == docs.columns and again.count() >= len(ROWS)

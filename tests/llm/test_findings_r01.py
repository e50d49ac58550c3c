"""The whole job where the review of round 1 found less."""

import pickle
import zlib
from collections import Counter

import numpy as np

from quillon.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_language_model_gathers_nothing_that_grows(spark, monkeypatch):
    """No filter reaches the driver or a broadcast, and levels are those of the exact counts but for rare false hits."""
    from quillon.llm.langmodel import LogFrequencyFilter

    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(len(pickle.dumps(value))), real(self, value))[1])
    got = {r.doc_id: r for r in Q.op6_bloom_lm(spark, SF).collect()}
    monkeypatch.undo()
    assert max(sent, default=0) < 10_000
    texts = {r.doc_id: [*(w.decode() for w in (r.text or "").encode().lower().split()), None] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    one, two = Counter(), Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t)
            two.update(zip(["", *t], t))
    n, v = sum(one.values()), len(one)

    def means(counts):
        """What each level stands for: the mean of the counts in it."""
        c = np.array(list(counts.values()))
        level = LogFrequencyFilter.level(c, 1.5)
        return np.bincount(level, c, 65) / np.maximum(1, np.bincount(level, minlength=65))

    values = means(one), means(two)

    def quantised(c, order=0):
        return values[order][LogFrequencyFilter.level(np.array([c]), 1.5)[0]] if c else 0.0

    gaps = []
    for i, t in texts.items():
        want = 0.0
        for u, w in zip([None, *t], t):
            both, own, context = quantised(two["" if u is None else u, w], 1), quantised(one[w]), quantised(one[u])
            want += np.log10((min(both, context, own) + 16 * (own + 1) / (n + v + 1)) / (context + 16))
        gaps.append(abs(got[i].score - want) / abs(want))
    assert np.mean(gaps) < 0.03


def test_toxicity_indexes_all_words(spark):
    """Every word of the labelled rows is a term, so that a document that shares one has neighbours; 0.8 of the toxic rows go."""
    import corpus_pipeline
    from quillon.llm import toxicity
    from quillon.llm.shared import table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    assert set(model.terms) == {w for i, t in texts.items() if i in toxic for w in t}
    assert all(r.evidence for r in Q.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic and texts[r.doc_id])
    stay = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf).select("doc_id").collect()}
    gone = [toxic[i] for i in texts if i in toxic and i not in stay]
    assert sum(gone) >= 0.8 * len(gone) and sum(gone) >= 0.8 * sum(toxic[i] for i in texts if i in toxic)


def test_jaccard_links_are_all_found(spark):
    """n_links and the link table against brute force, with components of one block and of many."""
    from quillon.llm.jaccard import similarity_components, similarity_links
    from tests.llm.test_brute_force import shingled

    rng = np.random.default_rng(6)
    rows = []
    for k in range(3):
        base = [f"b{k}w{i}" for i in range(40)]
        for _ in range(40):
            text = base[:]
            for at in rng.integers(0, 40, rng.integers(0, 4)):
                text[at] = f"x{rng.integers(0, 50)}"
            rows.append(" ".join(text))
    rows += [rows[0], "", "alone"]
    sets = {i: frozenset(shingled(t, 2)) for i, t in enumerate(rows)}
    least = {s: min(i for i in sets if sets[i] == s) for s in sets.values() if s}
    want = {(u, v) for a, u in least.items() for b, v in least.items() if u < v and 5 * len(a & b) >= 4 * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    for block in (7, 512):
        got = {r.doc_id: r.n_links for r in similarity_components(docs, n=2, threshold="0.8", block=block).collect()}
        assert got == {i: sum(least[s] in pair for pair in want) if s else 0 for i, s in sets.items()}
        links = similarity_links(docs, n=2, threshold="0.8", block=block).collect()
        assert len(links) == len(want) and {(r.u, r.v): r.n_shared for r in links} == {(u, v): len(sets[u] & sets[v]) for u, v in want}
    assert len(want) > 100


def test_pipeline_mixing_learns_from_dropped_rows(spark, monkeypatch):
    """Posteriors of the mixing stage are those of a classifier that saw all labelled rows, whatever the stages before dropped."""
    import corpus_pipeline
    from quillon.llm import mixing
    from quillon.llm.shared import table

    sf = "/root/testdata/sf0.01"
    docs, toxic = table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    seen = []
    monkeypatch.setattr(mixing, "repeated", lambda mixed, columns, real=mixing.repeated: (seen.append(mixed), real(mixed, columns))[1])
    corpus_pipeline.mixed_to_target(spark, docs.join(toxic, "doc_id", "left_anti").select(*docs.columns), sf)
    got = {r.doc_id: r.mix_posteriors for r in seen[0].select("doc_id", "mix_posteriors").collect()}
    want = {r.doc_id: r.mix_posteriors for r in mixing.mix(docs, Q.labelled_domains(spark, sf), Q.TARGETS, keep=["doc_id"]).collect()}
    assert 0 < len(got) < len(want) and all(np.allclose(p, want[i]) for i, p in got.items())


def test_short_benchmark_items_are_found(spark):
    from quillon.llm import contamination

    docs = spark.createDataFrame([(1, "The quick, brown fox jumps over it"), (2, "brown fox"), (3, "fox brown quick"), (4, ""), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "Brown fox"), (11, "quick brown fox jumps"), (12, "fox"), (13, "..."), (14, "quick brown fox jumps over"), (15, "brown FOX!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item, r.containment) for r in contamination.find_contained(docs, items).collect()}
    assert got == {(d, i, 1, 1, 1.0) for d, i in [(1, 10), (1, 11), (1, 12), (1, 14), (1, 15), (2, 10), (2, 12), (2, 15), (3, 12)]}
    assert sorted(r.doc_id for r in contamination.drop_contaminated(docs, items).collect()) == [4, 5]

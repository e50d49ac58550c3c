"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* Terms: all words of the labelled sample.
* Weights: (1 + log tf) * idf * evidence, normalised to length 1. Document frequencies are counted over *all* documents; the evidence of a word is the
  absolute log-ratio of its smoothed rates in the two classes, so words that both classes use alike count little, and none is left out.
* Index: postings by term for words in at most one of ``spread`` examples; the others, few, are kept as a matrix, and examples lie in blocks of ``block``
  rows in which each of these terms keeps its largest weight. A query adds up the postings exactly, bounds the rest of every row by its block's maxima, and
  scores exactly each row whose bound reaches the k-th best cosine so far: no neighbour is missed.
* Votes: neighbours vote with their cosine; a logistic curve fitted to leave-one-out votes of the sample (weighted back to
  the labelled population) turns votes into probabilities.

The sample: at most ``max_examples`` labelled rows of each class, those with the least hash; it bounds the index, which is
broadcast (the words of ``max_examples`` * 2 rows).  Everything else covers whole texts of all rows.

A text without known terms, also null and empty ones, gets the fitted probability of a vote of zero.  Repeated rows are
scored alike; ties between neighbours are broken by the example's position.  Without labelled rows of both classes the score is the share of
the one that exists (0 without any).  Other columns of ``docs`` pass through; tox_score and tox_evidence are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.llm.text import release, slices, words


@dataclass
class ToxicityModel:
    k: int
    block: int
    terms: dict[bytes, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    label: np.ndarray = field(default_factory=lambda: np.empty(0))
    example_id: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    spread: int = 16
    start: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    row: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    matrix: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    maxima: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    slope: float = 0.0
    offset: float = 0.0

    def vectors(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The vectors of several texts: ascending terms and weights."""
        tokens = [words(t) for t in texts]
        lens = np.array([len(x) for x in tokens], np.int64)
        found = np.fromiter(map(self.terms.get, chain.from_iterable(tokens), repeat(-1)), np.int64, int(lens.sum()))
        del tokens
        of = np.repeat(np.arange(len(texts)) * len(self.idf), lens)
        both, c = np.unique((of + found)[found >= 0], return_counts=True)
        of, t = np.divmod(both, max(1, len(self.idf)))
        w = (1 + np.log(c)) * self.idf[t]
        of, t, w = of[w > 0], t[w > 0], w[w > 0]
        w = w / np.sqrt(np.bincount(of, w * w, len(texts)))[of]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        return [(t[a:b], w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def weighted(self, t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector of ascending terms and their counts."""
        w = (1 + np.log(c)) * self.idf[t]
        t, w = t[w > 0], w[w > 0]
        return t, w / np.sqrt((w * w).sum())

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n, n_terms = len(vectors), len(self.idf)
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors])
        often = self.often(term, n)
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        self.matrix = np.zeros((n, int(often.sum())))
        dense = often[term]
        self.matrix[row[dense], self.common[term[dense]]] = weight[dense]
        edges = np.arange(0, n, self.block)
        tops = np.maximum.reduceat(self.matrix, edges).astype(np.float32)
        self.maxima = np.ascontiguousarray(np.nextafter(tops, np.float32(2), where=tops > 0, out=np.zeros_like(tops)).T)
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        order = np.lexsort((row, term))
        self.row, self.weight = row[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def often(self, term: np.ndarray, n: int) -> np.ndarray:
        """Terms in more than one of ``spread`` of the ``n`` examples that ``term`` lists the terms of."""
        return np.bincount(term, minlength=len(self.idf)) * self.spread > n

    def _whole(self, ids: np.ndarray, scores: np.ndarray, place: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Exact cosines of some examples, from what their postings add up to."""
        return scores[ids] + self.matrix[ids[:, None], place] @ near

    def neighbours(self, t: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine over 0, best first."""
        if not len(t) or not len(self.label):
            return np.empty(0, np.int64), np.empty(0)
        place = self.common[t]
        rare, far = t[place < 0], w[place < 0]
        place, near = place[place >= 0], w[place >= 0]
        a, lens = self.start[rare], self.start[rare + 1] - self.start[rare]
        at = np.arange(int(lens.sum())) + np.repeat(a - np.cumsum(lens) + lens, lens)
        scores = np.bincount(self.row[at], self.weight[at] * np.repeat(far, lens), len(self.label))
        if but >= 0:
            scores[but] = -2
        ids = np.flatnonzero(scores > 0)
        if len(place):
            bounds = scores + np.repeat(near @ self.maxima[place], self.block)[: len(scores)]
            some = min(2 * self.k, len(scores))
            first = np.argpartition(-bounds, some - 1)[:some]
            found = self._whole(first, scores, place, near)
            kth = np.partition(found, -self.k)[-self.k] if len(found) >= self.k else 0.0
            ids = np.flatnonzero(bounds >= max(kth - 1e-9, 1e-12))
            scores = self._whole(ids, scores, place, near)
        else:
            scores = scores[ids]
        if len(scores) > self.k:
            kth = np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[scores >= kth], scores[scores >= kth]
        best = np.lexsort((ids, -scores))[: self.k]
        best = best[scores[best] > 0]
        return ids[best], scores[best]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """Cosine-weighted share of label 1 among the neighbours, drawn to 0 where they are few or far."""
        return float((cosines * self.label[ids]).sum() / (cosines.sum() + 0.5)) if len(ids) else 0.0

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_examples: int) -> tuple[list, dict[int, int]]:
    """At most ``max_examples`` rows of each class (id, text, label) by least hash, and the size of each class."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    classes = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    picked = None
    for y in (0, 1):
        rows = marked.where(F.col("label") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(max_examples)
        picked = rows if picked is None else picked.unionByName(rows)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    found = [(r.doc_id, bytes(r.text or b""), r.label) for r in rows.select("doc_id", "text", "label").collect()]
    return sorted(dict.fromkeys(found)), classes


def document_frequency(docs: DataFrame, vocabulary: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each vocabulary word stands. A task sends one count a word."""
    place = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches):
        at = place.value
        counts, n = np.zeros(len(at), np.int64), 0
        known = at.keys()
        for batch in batches:
            for text in batch.column(0):
                n += 1
                counts[[at[w] for w in known & set(words(text.as_py()))]] += 1
        release()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(counts), -1), pa.int32()), pa.array(np.append(counts[counts > 0], n), pa.int64())], ["term", "n"])

    def packed(batches):
        for batch in batches:
            term, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (term.astype(np.int32), n.astype(np.int64))], ["term", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, total = np.zeros(len(vocabulary), np.int64), 0
    for r in rows.mapInArrow(packed, "term binary, n binary").collect():
        term, n = np.frombuffer(r.term, np.int32), np.frombuffer(r.n, np.int64)
        df[term[term >= 0]] = n[term >= 0]
        total += int(n[term < 0].sum())
    return df, total


def _evidence(term: np.ndarray, label: np.ndarray, n_terms: int, classes: tuple[int, int]) -> np.ndarray:
    """Absolute log-ratios of the smoothed rates at which the rows of the two classes hold each term. term, label: one entry a term of a row."""
    rates = [np.log((np.bincount(term[label == y], minlength=n_terms) + 1) / (classes[y] + 2)) for y in (0, 1)]
    return np.abs(rates[1] - rates[0])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    k: int = 15,
    block: int = 16,
    max_examples: int = 4000,
    min_rows: int = 1,
    least: float = 0.0,
) -> ToxicityModel:
    """The model from ``labels`` (doc_id, ``label`` 0/1); rows of other labels are ignored.

    Words of fewer than ``min_rows`` examples or less than ``least`` evidence weigh nothing; by default there are none.
    """
    sample, classes = labelled_sample(docs, labels, label, max_examples)
    y = np.array([s[2] for s in sample], np.float64)
    model = ToxicityModel(k, block, label=y, example_id=np.array([s[0] for s in sample], np.int64))
    if len(set(y)) < 2:
        model.offset = 30.0 if len(y) and y[0] else -30.0
        model.label = np.empty(0)
        return model
    terms: dict[bytes, int] = {}
    counts = []
    for _, text, _ in sample:
        counts.append(np.unique(np.array([terms.setdefault(w, len(terms)) for w in words(text)], np.int64), return_counts=True))
    df, n = document_frequency(docs, list(terms))
    model.terms = terms
    every, owner = np.concatenate([t for t, _ in counts]), np.repeat(np.arange(len(counts)), [len(t) for t, _ in counts])
    #: Evidence is a factor of idf, so a weight is one number a term.
    evidence = _evidence(every, y[owner], len(terms), (int((y == 0).sum()), int((y == 1).sum())))
    evidence[(np.bincount(every, minlength=len(terms)) < min_rows) | (evidence < least)] = 0.0
    model.idf = (np.log((1 + n) / (1 + df)) + 1) * evidence
    vectors = [model.weighted(t, c) for t, c in counts]
    #: Examples that share their strongest common term lie in the same blocks, so bounds are tight.
    often = model.often(every, len(counts))
    strongest = [int(t[often[t]][np.argmax(w[often[t]])]) if often[t].any() else -1 for t, w in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (strongest[i], i))
    del counts, every, owner
    vectors = [vectors[i] for i in order]
    model.label, model.example_id = y[order], model.example_id[order]
    if not any(len(t) for t, _ in vectors):
        model.label = np.empty(0)
        model.offset = float(np.log(classes.get(1, 0) / max(1, classes.get(0, 0))))
        return model
    model.build(vectors)
    votes = np.array([model.vote(*model.neighbours(t, w, i)) for i, (t, w) in enumerate(vectors)])
    share = {c: classes.get(c, 0) / max(1, int((model.label == c).sum())) for c in (0, 1)}
    model.slope, model.offset = _logistic(votes, model.label, np.where(model.label == 1, share[1], share[0]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic regression of one feature by Newton steps, with smoothed targets."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p)
        grad = np.array([(g * x).sum() + ridge * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        size = max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: ToxicityModel, evidence: int = 3, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``tox_score`` and ``tox_evidence`` (the nearest examples: doc_id, cosine, label). No shuffle."""
    docs = docs.drop("tox_score", "tox_evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            scores, ids, cosines = [], [], []
            for part in slices(texts, 1 << 20):
                for t, w in m.vectors(part):
                    i, c = m.neighbours(t, w)
                    scores.append(m.probability(m.vote(i, c)))
                    ids.append(i[:evidence])
                    cosines.append(c[:evidence])
            i = np.concatenate([np.empty(0, np.int64), *ids])
            examples = [pa.array(m.example_id[i], pa.int64()), pa.array(np.concatenate([np.empty(0), *cosines])), pa.array(m.label[i].astype(np.int32))]
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(examples, ["doc_id", "cosine", "label"])).cast(kinds)
            kept = [i for i, name in enumerate(batch.schema.names) if keep_text or name != "text"]
            columns = [*(batch.column(i) for i in kept), pa.array(scores, pa.float64()), near]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), "tox_score", "tox_evidence"])
            del batch, texts, columns
        release()

    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    added = StructType.fromDDL("tox_score double, tox_evidence array<struct<doc_id: long, cosine: double, label: int>>").fields
    return docs.mapInArrow(run, StructType(fields + added))

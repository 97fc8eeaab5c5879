"""Toxic spans by a linear-chain conditional random field, and document scores.

Labels mark documents, so tokens are labelled first: over the distinct
sentences of labelled documents, a word or word beginning is evidence if
nearly all sentences that hold it come from toxic documents (sentences and not
documents, so that copies count once). Words of any length can be evidence, beginnings from
four letters on. Tokens of toxic documents that carry evidence are labelled 1, tokens of clean
documents 0, also those that look like evidence. A two-label chain is
fitted to them: weights of the word, its beginnings, its end and its kind of
characters, and weights of the label changes. For a text, forward and
backward messages give every token's marginal; the spans are the runs of
tokens with a marginal of one half or more, with their character offsets. The
document score is a logistic function, fitted on labelled documents, of the
largest marginal (as log odds) and of the expected number of toxic tokens.

With two labels a message is one number, the log odds of label 1, and all
sentences of a batch advance together. Every text is scored whole; only the
fit is on a bounded sample (``max_rows`` labelled documents of each class,
those of the smallest hashes; ``max_sentences`` sentences of toxic documents with evidence, as many of clean
documents with and without; ``max_evidence`` words and beginnings, the most frequent). For training a sentence of
over ``LONGEST_TRAINING`` words counts as several of that many, so a text without sentence ends teaches like any other.

Edge cases: a null or empty text has no tokens and gets the score of a text
without any evidence. Without labels of both classes every score is the
share of label 1 (0 without labels). Labels that are null are not learned from;
of labels repeated for one id the largest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabclean.llm.common import no_nulls, slices, split_on, stored

MAX_ROWS = 8000
MAX_SENTENCES = 6000
LEAST_SUPPORT = 6
LEAST_SHARE = 0.9
MAX_EVIDENCE = 6000
LONGEST_TRAINING = 200
MOST_CACHED = 150_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BREAKS = re.compile(r"[\t-\r]")
_ENDS = (".", "!", "?", ".\"", ".)")
BIAS = "bias"


def word_of(chunk: str) -> str:
    """A chunk in lower case without what is no letter or digit at its ends."""
    word = chunk.lower()
    return word if word.isalnum() else _EDGES.sub("", word)


def features(word: str) -> list[str]:
    """What the chain sees of a word; the first are candidates for evidence."""
    if not word:
        return ["none"]
    out = [f"w:{word}", *[f"p:{word[:n]}" for n in (4, 5, 6) if len(word) > n]]
    return [*out, f"p:{word[:3]}", f"s:{word[-3:]}", "alpha" if word.isalpha() else "other", BIAS]


def evidence_of(word: str) -> list[str]:
    return [f for f in features(word) if f.startswith("w:") or f.startswith("p:") and len(f) > 5]


def sentences(words: list[str], ends: list[bool]) -> Iterator[list[str]]:
    """Cut words behind those that end a sentence."""
    begin = 0
    for i, end in enumerate(ends):
        if end or i == len(words) - 1:
            yield words[begin:i + 1]
            begin = i + 1


def even_spaces(texts: pa.Array) -> pa.Array:
    """The texts with every ASCII white-space character as a space (offsets stay)."""
    texts = pa.array(texts.to_pylist(), pa.string()) if texts.offset else texts
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = 32
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)].tobytes()))


def _messages(emission: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: float):
    """Forward and backward log odds of label 1 for every token of all sequences.

    ``moves``: log weights of going from label i to label j.
    """
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    first, size = bounds[:-1][order], length[order]
    forward, backward = np.empty(len(emission)), np.zeros(len(emission))
    stay0, up, down, stay1 = moves[0, 0], moves[0, 1], moves[1, 0], moves[1, 1]
    odds = np.full(len(first), begin)
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), "left")
    for t in range(steps):
        at = first[:live[t]] + t
        if t:
            odds = odds[:live[t]]
            odds = np.logaddexp(up, stay1 + odds) - np.logaddexp(stay0, down + odds)
        else:
            odds = odds[:live[t]]
        odds = odds + emission[at]
        forward[at] = odds
    back = np.zeros(0)
    for t in range(steps - 1, 0, -1):
        at = first[:live[t]] + t
        back = np.concatenate([back, np.zeros(live[t] - len(back))])
        x = back + emission[at]
        back = np.logaddexp(down, stay1 + x) - np.logaddexp(stay0, up + x)
        backward[at - 1] = back
    return forward, backward


class Chain:
    """A two-label linear-chain CRF with binary features."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, begin: float):
        self.weights, self.moves, self.begin = weights, moves, begin

    def emission(self, word: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features(word)])

    def odds(self, emission: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of label 1 of every token, given its whole sequence."""
        forward, backward = _messages(emission, bounds, self.moves, self.begin)
        return forward + backward

    @classmethod
    def fit(cls, texts: list[list[str]], labels: list[list[int]], steps: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
        """Maximum likelihood with a ridge, by Adam on the whole sample."""
        names: dict[str, int] = {}
        token, feature = [], []
        words = [w for s in texts for w in s]
        for i, w in enumerate(words):
            for f in features(w):
                token.append(i)
                feature.append(names.setdefault(f, len(names)))
        token, feature = np.array(token), np.array(feature)
        y = np.array([v for s in labels for v in s], float)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in texts])])
        first = bounds[:-1]
        inner = np.ones(len(words), bool)
        inner[first] = False
        inner = np.flatnonzero(inner)
        n = max(1, len(texts))
        seen = np.bincount(feature, weights=y[token], minlength=len(names))
        seen_moves = np.array([[((1 - y[inner - 1]) * (1 - y[inner])).sum(), ((1 - y[inner - 1]) * y[inner]).sum()],
                               [(y[inner - 1] * (1 - y[inner])).sum(), (y[inner - 1] * y[inner]).sum()]])
        theta = np.zeros(len(names) + 5)
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            moves, begin = theta[-5:-1].reshape(2, 2), theta[-1]
            emission = np.bincount(token, weights=theta[feature], minlength=len(words))
            forward, backward = _messages(emission, bounds, moves, begin)
            odds = forward + backward
            p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            a, b = forward[inner - 1], backward[inner] + emission[inner]  # odds of the two ends of a move
            logs = np.stack([np.full_like(a, moves[0, 0]), moves[0, 1] + b, moves[1, 0] + a, moves[1, 1] + a + b])
            share = np.exp(logs - logs.max(axis=0))
            share /= share.sum(axis=0)
            slope = np.concatenate([np.bincount(feature, weights=p[token], minlength=len(names)) - seen,
                                    (share.sum(axis=1).reshape(2, 2) - seen_moves).ravel(), [(p[first] - y[first]).sum()]]) / n
            slope += ridge * theta
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
            theta -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}
        return cls(weights, theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))


class Scorer:
    """The chain with the logistic function of a document; keeps emissions of words seen."""

    def __init__(self, chain: Chain | None, curve: np.ndarray):
        self.chain, self.curve = chain, curve
        self.seen: dict[str, tuple[float, bool]] = {}

    def __getstate__(self):
        return {"chain": self.chain, "curve": self.curve, "seen": {}}

    def tokens(self, texts: pa.Array):
        """Log odds, character offsets and lengths of every token (chunk), and bounds by text."""
        if len(self.seen) > MOST_CACHED:
            self.seen.clear()
        codes, chunks, bounds = split_on(even_spaces(texts))
        found = []
        for c in chunks:
            hit = self.seen.get(c)
            if hit is None:
                hit = self.seen[c] = (self.chain.emission(word_of(c)), c.endswith(_ENDS))
            found.append(hit)
        emission = np.array([e for e, _ in found])[codes]
        ends = np.array([e for _, e in found], bool)[codes]
        ends[bounds[1:] - 1] = True
        cuts = np.concatenate([[0], np.flatnonzero(ends) + 1])
        size = np.array([len(c) for c in chunks])[codes]
        begin = np.cumsum(size + 1) - size - 1
        begin -= np.repeat(begin[bounds[:-1]], np.diff(bounds))
        return self.chain.odds(emission, cuts), begin, size, bounds

    def summary(self, texts: pa.Array) -> np.ndarray:
        """Of each text: largest log odds of a token, and log of one plus the expected toxic tokens."""
        odds, _, _, bounds = self.tokens(texts)
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        return np.stack([np.clip(np.maximum.reduceat(odds, bounds[:-1]), -12, 12),
                         np.log1p(np.add.reduceat(np.where(p >= 0.05, p, 0), bounds[:-1]))], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.chain is None or not len(texts):
            return np.full(len(texts), self.curve[0])
        return 1 / (1 + np.exp(-(self.curve[0] + self.summary(texts) @ self.curve[1:])))

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, float]]]:
        """Runs of tokens with a marginal of one half or more: (begin, end, largest marginal)."""
        if self.chain is None or not len(texts):
            return [[] for _ in range(len(texts))]
        odds, begin, size, bounds = self.tokens(texts)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(texts))]
        last = -2
        for i in np.flatnonzero(odds >= 0).tolist():
            doc = int(np.searchsorted(bounds, i, "right")) - 1
            p = float(1 / (1 + np.exp(-min(odds[i], 50.0))))
            a, b = int(begin[i]), int(begin[i] + size[i])
            if last == i - 1 and out[doc]:
                a, p = out[doc][-1][0], max(p, out[doc].pop()[2])
            out[doc].append((a, b, p))
            last = i
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights (constant first) by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, max_rows: int):
    """At most ``max_rows`` labelled documents of each class, and the counts of the classes."""
    known = (labels.filter(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_y")))
    known = stored(known, "toxic-labels")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    h = F.xxhash64("_id", F.lit(23))
    picked = None
    for y in (False, True):
        part = known.filter(F.col("_y") == y).orderBy(h, "_id").limit(max_rows)
        picked = part if picked is None else picked.union(part)
    picked = stored(picked, "toxic-picked")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = rows.join(F.broadcast(picked), "_id").filter(F.col("_text").isNotNull()).select("_y", "_text")
    return stored(sample, "toxic-sample"), counts


def _cut_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, toxic = [], []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunks = _BREAKS.sub(" ", text).split(" ")  # at ASCII white space, as in scoring
            chunks = [c for c in chunks if c]
            for part in sentences(chunks, [c.endswith(_ENDS) for c in chunks]):
                for at in range(0, len(part), LONGEST_TRAINING):
                    texts.append(" ".join([word_of(c) for c in part[at:at + LONGEST_TRAINING]]))
                    toxic.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(toxic, pa.bool_())], names=["s", "toxic"])


def _count_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for s, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({f for w in set(s.split(" ")) for f in evidence_of(w)})
        names = [*counts[0], *counts[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([*counts[0].values(), *[0] * len(counts[1])], pa.int64()),
             pa.array([*[0] * len(counts[0]), *counts[1].values()], pa.int64())], names=["f", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS, max_sentences: int = MAX_SENTENCES, max_evidence: int = MAX_EVIDENCE) -> Scorer:
    """Fit chain and document score on a bounded sample of labelled rows where ``train`` (on the id) holds."""
    sample, counts = labelled_sample(docs, labels, train, id_col, text_col, label_col, max_rows)
    n0, n1 = counts.get(False, 0), counts.get(True, 0)
    flat = Scorer(None, np.array([n1 / (n0 + n1) if n0 + n1 else 0.0]))
    if not n0 or not n1:
        return flat
    cut = sample.mapInArrow(_cut_sentences, "s string, toxic boolean").filter("s != ''")
    distinct = stored(cut.groupBy("s").agg(F.min("toxic").alias("toxic")), "toxic-sentences")
    counted = distinct.mapInArrow(_count_evidence, "f string, clean bigint, toxic bigint").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = counted.filter((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    evidence = frozenset(r["f"] for r in strong.orderBy(F.desc("toxic"), "f").limit(max_evidence).collect())
    if not evidence:
        return flat
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [any(f in shared.value for w in s.split(" ") for f in evidence_of(w)) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.bool_())], names=["s", "toxic", "held"])

    marked = distinct.mapInArrow(mark, "s string, toxic boolean, held boolean")
    texts, tags = [], []
    for toxic, with_evidence in ((True, True), (False, True), (False, False)):  # of a toxic document, sentences without evidence are in doubt
        part = marked.filter((F.col("toxic") == toxic) & (F.col("held") == with_evidence))
        for r in part.orderBy(F.xxhash64("s"), "s").limit(max_sentences).collect():
            texts.append(r["s"].split(" "))
            tags.append([int(toxic and any(f in evidence for f in evidence_of(w))) for w in texts[-1]])
    scorer = Scorer(Chain.fit(texts, tags), np.zeros(3))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                x = held.value.summary(no_nulls(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "a", "b"])

    rows = sample.mapInArrow(summaries, "y boolean, a double, b double").collect()  # at most 2 * max_rows rows
    y = np.array([r["y"] for r in rows], float)
    k1 = max(1.0, y.sum())
    k0 = max(1.0, len(y) - y.sum())
    scorer.curve = logistic(np.array([[r["a"], r["b"]] for r in rows]), y, np.where(y > 0, n1 / k1, n0 / k0))
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score and predicted (1 from one half on) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.score(no_nulls(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id bigint, score double, predicted int").withColumnRenamed("_id", id_col)


def tag(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and toxic spans (character offsets begin and end, marginal p) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(("begin", "end", "p"), s)) for s in doc] for doc in shared.value.spans(no_nulls(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["_id", "spans"])
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id bigint, spans array<struct<begin:int,end:int,p:double>>").withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is below ``least``; all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.score(no_nulls(batch.column(at))) < least))
    return docs.mapInArrow(run, docs.schema)

"""Language identification, word first with backoff to character n-grams.

Words are maximal runs of letters in lower case. A word that training has
seen scores by its log frequency in each language. An unseen word falls back
to its character n-grams: the longest order with a known n-gram decides, as
the mean over its known n-grams of that order; then shorter orders, down to
single characters. A word of which nothing is known says nothing. The scores
of the words add up, and a softmax over the languages gives the result.

The model is fit on a bounded sample of labelled rows: about ``max_rows`` of each
language (those of the smallest hashes of the ids, so it does not depend on the order
of the rows), all of a language that has fewer, so a rare one is learned too. It keeps
every word of the sample (or the ``max_words`` most frequent, where that is given); n-grams
are counted in Spark from every word. The broadcast is bounded by the sampled
rows. Every text is scored whole.

Summed scores grow with a text's length, so they say which learned language fits best
and not whether one fits. ``keep_identified`` therefore also asks for the share of a text's
words that training has seen, which does not grow with length: of a text in no learned language, or of
random letters, few are.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0.
Without any labelled row every text gets ``und``. Ties go to the language
that sorts first. Rows with a null language are never learned from. Repeated rows are
scored alike, each for itself; the sample takes all or none of the rows of one id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabclean.llm.common import no_nulls, slices, stored

MAX_ROWS = 1500  # of each language
LEAST_KNOWN, JUDGED_WORDS = 0.2, 10  # share of seen words, and the words from which it is asked for
MOST_CACHED = 100_000
ORDERS = 4
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


class Model:
    """Log frequencies of words and character n-grams, one column a language."""

    def __init__(self, counts: Iterable[tuple[str, str, int]], orders: int = ORDERS, grams: Iterable[tuple[str, str, int]] | None = None):
        """``counts``: (word, language, count); ``grams``: the same of n-grams, by default those of the words given."""
        counts, self.orders = list(counts), orders
        if grams is None:
            found: Counter = Counter()
            for word, lang, n in counts:
                for gram in self.all_ngrams(word, orders):
                    found[gram, lang] += n
            grams = [(gram, lang, n) for (gram, lang), n in found.items()]
        by_order: list[list] = [[] for _ in range(orders)]
        for cell in grams:
            by_order[len(cell[0]) - 1].append(cell)
        self.langs = sorted({lang for cells in (counts, *by_order) for _, lang, _ in cells})
        self.words = self.table(counts)
        self.grams = [self.table(cells) for cells in by_order]

    def table(self, cells: list[tuple[str, str, int]]) -> tuple[dict[str, int], np.ndarray]:
        """Row number of each entry, and the logs of their smoothed shares in each language."""
        index: dict[str, int] = {}
        place = {lang: i for i, lang in enumerate(self.langs)}
        rows = np.fromiter((index.setdefault(entry, len(index)) for entry, _, _ in cells), np.int64, len(cells))
        cols = np.fromiter((place[lang] for _, lang, _ in cells), np.int64, len(cells))
        sums = np.zeros((len(index), len(self.langs)))
        np.add.at(sums, (rows, cols), np.fromiter((n for _, _, n in cells), float, len(cells)))
        return index, self.logs(sums)

    @staticmethod
    def ngrams(word: str, n: int) -> list[str]:
        padded = f" {word} " if n > 1 else word
        return [padded[i:i + n] for i in range(len(padded) - n + 1)]

    @staticmethod
    def all_ngrams(word: str, orders: int) -> list[str]:
        return [gram for n in range(1, orders + 1) for gram in Model.ngrams(word, n)]

    @staticmethod
    def logs(table: np.ndarray) -> np.ndarray:
        """Logs of the smoothed shares of the entries (rows) in each language (columns)."""
        return np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * (len(table) + 1)))

    def score(self, word: str) -> np.ndarray | None:
        index, table = self.words
        if word in index:
            return table[index[word]]
        for n in range(self.orders, 0, -1):
            index, table = self.grams[n - 1]
            known = [index[g] for g in self.ngrams(word, n) if g in index]
            if known:
                return table[known].mean(axis=0)
        return None


class Seen(dict):
    """Rows of words in one table of scores: those that training has seen come first, the others as they are met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, (self.index, table) = model, model.words
        self.first = len(table)
        self.table = np.concatenate([table - table.max(axis=1, keepdims=True) if table.size else table, np.zeros((1024, table.shape[1]))])

    def __missing__(self, word: str) -> int:
        n = self[word] = self.first + len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(1024, len(self)), self.table.shape[1]))])
        row = self.model.score(word)
        self.table[n] = 0.0 if row is None else row - row.max()
        return n

    def rows(self, words: Iterable[str]) -> np.ndarray:
        find = self.index.get
        return np.array([self[w] if (n := find(w)) is None else n for w in words], np.int64)

    def trim(self) -> None:
        if len(self) > MOST_CACHED:
            self.clear()


def predict(model: Model, texts: list[str], seen: dict) -> tuple[list[str], list[float]]:
    """Language and posterior of each text; ``seen`` (a ``Seen``) keeps word scores between calls."""
    return judged(model, texts, seen)[:2]


def judged(model: Model, texts: list[str], seen: dict) -> tuple[list[str], list[float], list[int], list[int]]:
    """Language, posterior, words and words that training has seen of each text."""
    seen = seen if isinstance(seen, Seen) else Seen(model)
    langs, scores, sizes, known = [], [], [], []
    for text in texts:
        words = Counter(_WORD.findall(text.lower()))
        if not words or not model.langs:
            langs.append(UNKNOWN)
            scores.append(0.0)
            sizes.append(sum(words.values()))
            known.append(0)
            continue
        rows = seen.rows(words)
        counts = np.fromiter(words.values(), float, len(words))
        total = counts @ seen.table[rows]
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        langs.append(model.langs[best])
        scores.append(float(share[best] / share.sum()))
        sizes.append(int(counts.sum()))
        known.append(int(counts[rows < seen.first].sum()))
    return langs, scores, sizes, known


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Words of labelled rows, counted by language in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(no_nulls(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                counts.update((word, lang) for word in _WORD.findall(text.lower()))
            words, langs = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(langs, pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "lang", "n"])
    pairs = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    return (pairs.mapInArrow(run, "word string, lang string, n bigint")
            .groupBy("word", "lang").agg(F.sum("n").alias("n")))


def gram_counts(counted: DataFrame, orders: int) -> DataFrame:
    """Character n-grams of counted words, counted by language in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for word, lang, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for gram in Model.all_ngrams(word, orders):
                    counts[gram, lang] += n
            grams, langs = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.string()), pa.array(langs, pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["gram", "lang", "n"])
    return (counted.select("word", "lang", "n").mapInArrow(run, "gram string, lang string, n bigint")
            .groupBy("gram", "lang").agg(F.sum("n").alias("n")))


def sample_by_language(docs: DataFrame, id_col: str, lang_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of each language, or all it has: those whose id's hash lies under the language's share."""
    counts = docs.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))  # a row a language
    h = F.xxhash64(F.col(id_col), F.lit(17)).cast("double") / F.lit(2.0**64) + F.lit(0.5)  # from 0 to 1
    return (docs.join(F.broadcast(counts), F.col(lang_col) == F.col("_lang"))
            .filter(h * F.col("_n") <= F.lit(float(max_rows))).drop("_lang", "_n"))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_rows: int = MAX_ROWS, max_words: int | None = None, orders: int = ORDERS) -> Model:
    """Fit on labelled rows where ``train`` holds, from a bounded sample of them."""
    labelled = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)
    counted = stored(word_counts(sample_by_language(labelled, id_col, lang_col, max_rows), text_col, lang_col), "langid-words")
    kept = counted
    if max_words is not None:
        most = counted.groupBy("word").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "word").limit(max_words).select("word")
        kept = counted.join(most, "word")
    kept = kept.toArrow()  # the words of the sample, a row a language
    grams = gram_counts(counted, orders).toArrow()  # every n-gram of the sample, a row a language
    cells = lambda table, entry: sorted(zip(*[table.column(c).to_pylist() for c in (entry, "lang", "n")]))
    return Model(cells(kept, "word"), orders, cells(grams, "gram"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(shared.value)
        for batch in slices(batches):
            seen.trim()
            langs, scores = predict(shared.value, no_nulls(batch.column(1)).to_pylist(), seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["_id", "lang_pred", "score"])
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id bigint, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5,
                    least_known: float = LEAST_KNOWN, judged_words: int = JUDGED_WORDS) -> DataFrame:
    """The rows whose language is found with a score of ``least`` or more; all columns kept.

    A text of ``judged_words`` words or more must also have ``least_known`` of them in common with what was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(shared.value)
        for batch in slices(batches):
            seen.trim()
            found = zip(*judged(shared.value, no_nulls(batch.column(at)).to_pylist(), seen))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least and (words < judged_words or known >= least_known * words)
                                         for lang, score, words, known in found], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)

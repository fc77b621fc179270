"""Language identification by unigram pieces, with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is
the sum over all its segmentations into pieces, by the forward algorithm; the piece probabilities are
fitted by expectation maximisation, whose expected counts come from the same sums.  A text goes to the
language that gives the words of the whole text the largest probability; the score is its share among
all languages.

The model is learned on a bounded sample: about ``SAMPLE`` labelled documents a language, chosen by a
hash of doc_id and text, each once; letter runs longer than ``PART`` are learned from in parts of that
length.  Each language is fitted in a task of its own.  Predictions use whole texts and whole letter
runs, of any length, and nothing but the text; the languages are scored ``LANGUAGES`` at a time, a pass
over the texts for each of such blocks, so any number of them can be told apart.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if
nothing could be learned; of equal languages the first in code-point order wins; repeated rows give
repeated results; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, read
from quarrylight.llm.pieces import MODEL, Pieces, by_length, load

SAMPLE = 600
#: Languages that are scored in one pass: what a task holds of the model is bounded by it.
LANGUAGES = 256
STEPS = 3
UNKNOWN = "und"
#: Longer letter runs are learned from in parts of this length, and scored by ``Model.log_run``.
PART = 24
#: Characters of a long run whose pieces are looked up at once.
BLOCK = 512
#: Words that a worker remembers.
MEMORY = 150_000
#: The probability of a character without a piece, and the share that all pieces get evenly.
NO_PIECE, SMOOTH = 1e-7, 1e-3
_WORD = re.compile(r"[^\W\d_]+")
# \w also takes in numerals that are no decimal digits; they are as good as white space
_NUMERALS = {c: " " for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}


def runs_of(text: str | None) -> list[str]:
    """Lower-cased letter runs with a space in front."""
    if not text:
        return []
    if not _NUMERALS.keys().isdisjoint(text):
        text = text.translate(str.maketrans(_NUMERALS))
    return [" " + w for w in _WORD.findall(text.lower())]


def words_of(text: str | None) -> list[str]:
    """The letter runs, long ones in parts."""
    out = []
    for w in runs_of(text):
        if len(w) <= PART + 1:
            out.append(w)
        else:
            out.append(w[: PART + 1])
            out.extend(w[a : a + PART] for a in range(PART + 1, len(w), PART))
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


class Model:
    """Piece probabilities of each language, and the sums over segmentations."""

    def __init__(self, languages: list[str], path: str = MODEL, prob: np.ndarray | None = None):
        self.languages, self.path = languages, path
        pieces = load(path)
        self.prob = np.full((len(pieces.keys) + 1, len(languages)), 1 / len(pieces.keys)) if prob is None else prob
        self.prob[-1] = 0  # index -1: no piece

    def _edges(self, pieces: Pieces, points: np.ndarray, prob: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at = pieces.at(points)
        weight = [prob[p] for p in at]
        weight[0] = np.where((at[0] >= 0)[..., None], weight[0], NO_PIECE)
        return at, weight

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word) for each word and language."""
        pieces = load(self.path)
        out = np.zeros((len(words), len(self.languages)))
        for rows, points in by_length(words):
            _, weight = self._edges(pieces, points, self.prob)
            out[rows] = np.log(self._forward(weight, points.shape)[-1])
        return out

    def log_run(self, run: str) -> np.ndarray:
        """log P(run) for each language, for a run of any length: the recursion in blocks, its last sums scaled."""
        pieces = load(self.path)
        _, points = next(by_length([run]))
        length, width = points.shape[1], pieces.longest
        # near[k - 1]: the sum of all segmentations up to k characters before, over exp(scale)
        near, scale = np.zeros((width, len(self.languages))), np.zeros(len(self.languages))
        near[0] = 1
        for a in range(0, length, BLOCK):
            # pieces that end in this block begin up to width - 1 characters before it
            begin, end = max(0, a - width + 1), min(a + BLOCK, length)
            _, weight = self._edges(pieces, points[:, begin:end], self.prob)
            into = np.zeros((end - a, *near.shape))
            for k, w in enumerate(weight, 1):
                first = max(a + 1, begin + k)
                into[first - a - 1 :, k - 1] = w[0, first - k - begin :]
            for i, edges in enumerate(into):
                near[1:], near[0] = near[:-1].copy(), (near * edges).sum(axis=0)
                if i % 8 == 7:
                    top = near.max(axis=0)
                    near /= top
                    scale += np.log(top)
        return scale + np.log(near[0])

    @staticmethod
    def _forward(weight: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
        alpha = [np.ones((shape[0], weight[0].shape[2]))]
        for end in range(1, shape[1] + 1):
            alpha.append(sum(alpha[end - k] * weight[k - 1][:, end - k] for k in range(1, min(end, len(weight)) + 1)))
        return alpha

    def fit(self, words: list[str], n: np.ndarray, steps: int = STEPS) -> np.ndarray:
        """Piece probabilities of one language from its words and their counts."""
        pieces = load(self.path)
        groups = list(by_length(words))
        prob = np.full((len(pieces.keys) + 1, 1), 1 / len(pieces.keys))
        prob[-1] = 0
        for _ in range(steps):
            expected = np.zeros(len(prob))
            for rows, points in groups:
                at, weight = self._edges(pieces, points, prob)
                alpha, length = self._forward(weight, points.shape), points.shape[1]
                beta = [np.ones((len(rows), 1)) for _ in range(length + 1)]
                for start in range(length - 1, -1, -1):
                    beta[start] = sum(beta[start + k] * weight[k - 1][:, start] for k in range(1, min(length - start, len(weight)) + 1))
                share = n[rows] / alpha[-1][:, 0]
                for k, found in enumerate(at, 1):
                    for start in range(found.shape[1]):
                        expected += np.bincount(np.where(found[:, start] >= 0, found[:, start], len(prob) - 1), share * alpha[start][:, 0] * weight[k - 1][:, start, 0] * beta[start + k][:, 0], len(prob))
            expected[-1] = 0
            total = expected.sum()
            if total > 0:
                prob[:, 0] = (1 - SMOOTH) * expected / total + SMOOTH / len(pieces.keys)
            prob[-1] = 0
        return prob[:, 0]


def learn(docs: DataFrame, sample: int = SAMPLE, path: str = MODEL) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``; the rows are those it may learn from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull())
    # a table by itself: its size is known, so that it goes to the texts and not they to it
    sizes = Scratch(docs.sparkSession, "langid").keep(docs.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000))
    chosen = docs.withColumn("place", place).join(sizes, "lang").where(F.col("place") < sample / F.col("n") * 1_000_000).select("doc_id", "lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[lang].update(words_of(text.as_py()))
            rows = [(g, w, n) for g, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word")
        prob = Model([], path).fit(group["word"].tolist(), group["n"].to_numpy(float))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "prob": [prob.tobytes()]})

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = {r["lang"]: np.frombuffer(r["prob"]) for r in counted.groupBy("lang").applyInPandas(fit, "lang string, prob binary").toLocalIterator()}
    # a language whose sample holds no letter is learned as having no piece of its own
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return None
    pieces = len(load(path).keys)
    even = np.r_[np.full(pieces, 1 / pieces), 0.0]
    return Model(languages, path, np.stack([fitted.get(g, even) for g in languages], axis=1))


def predict(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """``docs(text)`` to the columns ``carry``, lang_pred and score, a row for each row."""
    spark = docs.sparkSession
    out = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    fields = out.drop("__text").schema
    if model is None:
        return out.select(*carry, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = out.select("*", F.lit(None).cast("string").alias("__best"), F.lit(None).cast("double").alias("__top"), F.lit(0.0).alias("__sum"))
    for a in range(0, len(model.languages), LANGUAGES):
        # LANGUAGES x pieces of the vocabulary: a size that does not grow with the corpus
        shared = spark.sparkContext.broadcast((model.languages[a : a + LANGUAGES], model.path, model.prob[:, a : a + LANGUAGES]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(Model(shared.value[0], shared.value[1], shared.value[2].copy()))
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    *own, texts, best, top, total = part.columns
                    found = [_merged(x, y) for x, y in zip(zip(best.to_pylist(), top.to_pylist(), total.to_pylist()), scorer.sums(texts.to_pylist()))]
                    yield pa.RecordBatch.from_arrays([*own, texts, *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())))], part.schema.names)

        out = out.mapInArrow(run, fields.simpleString()[7:-1] + ", __text:string, __best:string, __top:double, __sum:double")
    return out.select(*carry, F.coalesce("__best", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("__best").isNull(), 0.0).otherwise(1 / F.col("__sum")).alias("score"))


def _merged(one: tuple, other: tuple) -> tuple:
    """Of two sets of languages the best one, its log probability, and the sum of all over its own."""
    if one[0] is None or other[0] is None:
        return other if one[0] is None else one
    best = one if one[1] >= other[1] else other
    return best[0], best[1], float(sum(x[2] * np.exp(x[1] - best[1]) for x in (one, other)))


class Scorer:
    """Scores texts; remembers up to MEMORY words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.logs = np.zeros((0, len(self.model.languages)))

    def sums(self, texts: list[str | None]) -> list[tuple[str | None, float | None, float]]:
        """Of each text the best language, its log probability, and the sum of all languages' probabilities over its own."""
        if len(self.index) > MEMORY:
            self._clear()
        runs = [runs_of(t) for t in texts]
        # long runs are rarely met again and not remembered
        rows, long = [[w for w in r if len(w) <= PART + 1] for r in runs], [[w for w in r if len(w) > PART + 1] for r in runs]
        ids = [np.fromiter(map(self.index.__getitem__, r), np.int64, len(r)) for r in rows]
        if len(self.index) > len(self.logs):
            self.logs = np.concatenate([self.logs, self.model.log_words(list(islice(self.index, len(self.logs), None)))])
        out: list[tuple[str | None, float | None, float]] = []
        for i, more in zip(ids, long):
            if not len(i) and not more:
                out.append((None, None, 0.0))
                continue
            total = np.zeros(len(self.model.languages))
            for a in range(0, len(i), 100_000):
                total += self.logs[i[a : a + 100_000]].sum(axis=0)
            for run in more:
                total += self.model.log_run(run)
            top = int(np.argmax(total))
            out.append((self.model.languages[top], float(total[top]), float(np.exp(total - total[top]).sum())))
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = self.sums(texts)
        return [UNKNOWN if b is None else b for b, _, _ in found], [0.0 if b is None else 1 / n for b, _, n in found]


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from the rows that aren't held out."""
    model = learn(docs.where(~held_out(F.col("doc_id")) | F.col("doc_id").isNull()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))

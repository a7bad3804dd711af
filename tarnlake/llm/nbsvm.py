"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: words and pairs of words (hashed), and runs of one to three word shapes, each shape
marked by whether the pair it ends has occurred in the text before; shape n-grams have an indicator for each of a few
shares of the text that they reach. Indicators are scaled by the logarithm of the ratio of their smoothed shares in the
two classes, and a linear model with hinge loss is fitted by dual coordinate descent.

The fit sees a bounded sample: the first SAMPLE pairs of doc_id and label that may be learned from, in the order of a hash
of the doc_id, each with one text (of rows that repeat the doc_id the least). The score is the logistic function of the
margin, so that 0.5 is the plane itself.

Defined cases: a null text counts as empty; an empty text has no n-grams and the score of the bias. Where one class has
no rows to learn from the score is 1 or 0, as the other class is; where none has, 0.5. Rows whose doc_id is null are not
learned from. Texts and words of any length are read whole, one text at a time. Repeated rows each give a row, an empty
table an empty table; columns named in `keep` pass through.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import hold, mapped, table, text_of
from .langid import remainder

#: Labelled rows learned from at most.
SAMPLE = 5000
#: Hashed features; shares of a text that a shape n-gram may reach; words of a worker's memory.
SPACE = 1 << 20
SHARES = (0.0, 0.02, 0.1, 0.3)
WORDS_KEPT = 250_000
LONGEST_KEPT = 48
#: Of the fit: smoothing of the counts, cost of an error, rounds.
ALPHA = 1.0
COST = 1.0
ROUNDS = 30
STEEP = 3.0

_KINDS = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^aA0])\1+"), r"\1+"))
_SEEN: dict[str, tuple[int, int]] = {}
_OPEN: dict[str, object] = {}


def word_codes(word: str) -> tuple[int, int]:
    """A hash of the word and one of its shape: runs of letters, capitals and digits as one sign each."""
    found = _SEEN.get(word)
    if found is None:
        shape = word
        for pattern, sign in _KINDS:
            shape = pattern.sub(sign, shape)
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_KEPT:
            if len(_SEEN) >= WORDS_KEPT:
                _SEEN.clear()
            _SEEN[word] = found
    return found


def features(text: str):
    """Sorted hashed features of a whole text; those of shapes lie in the upper half of the space."""
    import numpy as np

    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.array(list(map(word_codes, words)), np.uint64)
    word, shape = codes[:, 0], codes[:, 1]
    half = np.uint64(SPACE // 2)
    odd = np.uint64(0x9E3779B97F4A7C15)
    mixed = lambda x: ((x * odd) >> np.uint64(29)) % half
    pairs = word[:-1] * np.uint64(0x100000001B3) + word[1:]
    out = [mixed(np.unique(word)), mixed(np.unique(pairs) + np.uint64(1))]
    old = np.ones(len(words), np.uint64)
    old[1 + np.unique(pairs, return_index=True)[1]] = 0
    old[0] = 0
    sign = shape * np.uint64(2) + old
    for n in (1, 2, 3):
        if len(sign) < n:
            break
        run = np.full(len(sign) - n + 1, n, np.uint64)
        for k in range(n):
            run = run * np.uint64(0x100000001B3) + sign[k : len(sign) - n + 1 + k]
        found, count = np.unique(run, return_counts=True)
        for k, share in enumerate(SHARES):
            out.append(half + mixed(found[count > share * len(run)] * np.uint64(len(SHARES)) + np.uint64(k)))
    return np.unique(np.concatenate(out)).astype(np.int64)


class Model:
    """Weights of the features with the class ratios in them, the bias, and the constant score if there is no plane."""

    def __init__(self, weights, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant, self.key = weights, bias, constant, uuid.uuid4().hex

    def score(self, text: str) -> float:
        import math

        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, STEEP * self.margin(features(text))))))

    def margin(self, found) -> float:
        cut = found.searchsorted(SPACE // 2)
        total = self.bias
        for part in (found[:cut], found[cut:]):
            if len(part):
                total += float(self.weights[part].sum()) / len(part) ** 0.5
        return total


def ratios(rows: Sequence, labels):
    """Log ratio of every feature's smoothed share in class 1 to that in class 0."""
    import numpy as np

    counts = [np.full(SPACE, ALPHA), np.full(SPACE, ALPHA)]
    for found, y in zip(rows, labels, strict=True):
        counts[int(y)][found] += 1
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    return np.log((counts[1] / (n[1] + 2 * ALPHA)) / (counts[0] / (n[0] + 2 * ALPHA)))


def descend(rows: Sequence, values: Sequence, labels, costs, size: int, rounds: int = ROUNDS, seed: int = 1):
    """Dual coordinate descent for min |w|^2 / 2 + sum of costs * max(0, 1 - y w x); the last weight is the bias.

    rows and values are each row's features and their values; labels are 1 and -1.
    """
    import numpy as np

    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            slope = y * (float(w[x] @ v) + w[size]) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), costs[i])
            step = (new - alpha[i]) * y
            if step:
                moved = max(moved, abs(step))
                alpha[i] = new
                w[x] += step * v
                w[size] += step
        if moved < 1e-4:
            break
    return w


def fit(rows: Sequence, labels) -> Model:
    """From the features of each row and labels 0 and 1."""
    import numpy as np

    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return Model(None, 0.0, float(labels[0]) if len(labels) else 0.5)
    scale = ratios(rows, labels)
    values = []
    for found in rows:
        cut = int(np.searchsorted(found, SPACE // 2))
        sizes = np.r_[np.full(cut, max(1, cut)), np.full(len(found) - cut, max(1, len(found) - cut))]
        values.append(scale[found] / np.sqrt(sizes))
    y = np.where(labels == 1, 1.0, -1.0)
    share = {k: len(labels) / (2 * (y == k).sum()) for k in (1.0, -1.0)}
    w = descend(rows, values, y, np.array([COST * share[k] for k in y]), SPACE)
    return Model((w[:SPACE] * scale).astype(np.float32), float(w[SPACE]))


def train(docs: DataFrame, labels: DataFrame, label: str, learn, sample: int = SAMPLE) -> Model:
    """Learn column `label` of `labels` from the rows for which `learn`, a condition on `labels`, holds."""
    import numpy as np

    may = labels.filter(learn & labels["doc_id"].isNotNull() & labels[label].isin(0, 1)).select(labels["doc_id"], labels[label].cast("int").alias("y"))
    chosen = may.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "found"])

    got = [(r["y"], bytes(r["found"])) for r in mapped(texts, rows, "y int, found binary").toLocalIterator()]
    got.sort()  # the fit depends on the order
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for _, x in got], [y for y, _ in got])


def score_documents(docs: DataFrame, model: Model, keep: Sequence[str], name: str = "score") -> DataFrame:
    """The columns `keep` of `docs`, and the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    kept = docs.select(*(docs[c] for c in keep))
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hold("nbsvm", _SEEN.clear)
        score = shared.value.score
        for batch in batches:
            found = pa.array([score(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, name])

    return mapped(docs.select(*(docs[c].alias(f"c{k}") for k, c in enumerate(keep)), text_of(docs).alias("text")), rows, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, "quality", remainder(labels["doc_id"], 3) != 1)
    found = score_documents(docs, model, ["doc_id"])
    held_out = F.coalesce(remainder(found["doc_id"], 3) == 1, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

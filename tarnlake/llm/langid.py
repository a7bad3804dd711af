"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A text is its words (runs of letters, in
lower case, the space mark before each); the probability of a word is the sum over all ways to cut it into pieces, taken
by a forward algorithm over all words of a batch at once, and for words of more than LONGEST letters over one word at a
time, in logarithms. The language with the highest product of prior and word probabilities is predicted; its posterior is
the score.

Piece probabilities are learned by expectation maximisation over the words of a bounded sample: of the rows that may be
learned from, the first SAMPLE of each language in the order of a hash of the doc_id; of rows that repeat a doc_id the
least text. Their words are counted by Spark. Priors count all rows that may be learned from.

Letters are the characters of Unicode's categories L. Defined cases: a null text, or one without letters, gives `und` and
score 0; so does every text where no language can be learned. Rows whose doc_id is null are held out. Texts and words of
any length are scored whole: slices hold BYTES_AT_ONCE bytes of text or one longer text. Repeated rows each give a row, an
empty table an empty table; columns named in `keep` pass through.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import cut, hold, mapped, table, text_of, unused
from .words import slices

MARK = "▁"
#: Learned from: documents of each language, rounds of expectation maximisation, and what is added to a piece's count.
SAMPLE = 400
ROUNDS = 2
SMOOTH = 0.1
#: Probability of a letter that no piece covers, for any language.
UNKNOWN = 1e-7
#: Words of up to so many letters are taken many at a time and remembered; their probabilities are far from underflow.
LONGEST = 32
#: Words of a worker's memory; bytes of text scored at a time.
WORDS_KEPT = 250_000
BYTES_AT_ONCE = 1 << 20
UNDETERMINED = "und"

_RUNS = re.compile(r"[^\W\d_]+")
_OPEN: dict[str, Scorer] = {}


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # numbers such as a half, or in circles, are no letters
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class Vocabulary:
    """A trie over the pieces made of letters, as sorted arrays, walked by many words at a time."""

    def __init__(self, pieces: Sequence[str]):
        import numpy as np

        self.chars: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        self.n = len(pieces)
        at_node: dict[int, int] = {}
        for piece, text in enumerate(pieces):
            node = 0
            for c in text:
                key = (node, self.chars.setdefault(c, len(self.chars) + 1))
                node = nodes.setdefault(key, len(nodes) + 1)
            at_node[node] = piece
        self.longest = max(map(len, pieces), default=1)
        self.width = len(self.chars) + 1
        keys = np.array([a * self.width + b for a, b in nodes] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()) or [0], np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        for node, piece in at_node.items():
            self.piece[node] = piece

    @classmethod
    def of_model(cls, model: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        texts = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        return cls(sorted({t for t in texts if t == MARK or (body := t.removeprefix(MARK)).isalpha() and body == body.lower()}))

    def codes(self, words: Sequence[str]):
        """Words of equal length as rows of character codes, the mark first; 0 is no character of the vocabulary."""
        import numpy as np

        n = len(words[0]) + 1
        get = self.chars.get
        points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), "<u4")
        found, back = np.unique(points, return_inverse=True)
        return np.array([get(chr(c), 0) for c in found], np.int64)[back].reshape(len(words), n)

    def edges(self, codes) -> Iterator:
        """(start, end, rows, pieces) in the order of start: the rows in which a piece stands from start to end."""
        import numpy as np

        n = codes.shape[1]
        for i in range(n):
            rows = np.arange(len(codes))
            nodes = np.zeros(len(codes), np.int64)
            for j in range(i, min(n, i + self.longest)):
                code = codes[rows, j]
                keys = nodes * self.width + code
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                alive = (self.keys[at] == keys) & (code > 0)
                rows, nodes = rows[alive], self.to[at[alive]]
                if not len(rows):
                    break
                pieces = self.piece[nodes]
                ends = pieces >= 0
                if ends.any():
                    yield i, j + 1, rows[ends], pieces[ends]


    def edges_of(self, codes):
        """(starts, ends, pieces, first) of one word of any length, in the order of ends; those that end at j stand from
        first[j] to first[j + 1]."""
        import numpy as np

        n = len(codes)
        at, nodes = np.arange(n), np.zeros(n, np.int64)
        out = [np.zeros((3, 0), np.int64)]
        for depth in range(self.longest):
            inside = at + depth < n
            at, nodes = at[inside], nodes[inside]
            code = codes[at + depth]
            keys = nodes * self.width + code
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            alive = (self.keys[found] == keys) & (code > 0)
            at, nodes = at[alive], self.to[found[alive]]
            if not len(at):
                break
            pieces = self.piece[nodes]
            whole = pieces >= 0
            out.append(np.array([at[whole], at[whole] + depth + 1, pieces[whole]]))
        starts, ends, pieces = np.concatenate(out, 1)
        order = np.argsort(ends, kind="stable")
        return starts[order], ends[order], pieces[order], np.searchsorted(ends[order], np.arange(n + 2))


def by_length(words: Sequence[str]) -> list[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return [groups[k] for k in sorted(groups)]


def forward(codes, vocabulary: Vocabulary, chances):
    """Probability of each row by language: the sum over all segmentations. chances: piece by language."""
    import numpy as np

    n = codes.shape[1]
    alpha = np.zeros((n + 1, len(codes), chances.shape[1]))
    alpha[0] = 1
    done = 0
    for i, j, rows, pieces in vocabulary.edges(codes):
        while done < i:  # all that ends at done + 1 has been added, but for a letter by itself
            alpha[done + 1] += alpha[done] * UNKNOWN
            done += 1
        alpha[j, rows] += alpha[i, rows] * chances[pieces]
    while done < n:
        alpha[done + 1] += alpha[done] * UNKNOWN
        done += 1
    return alpha[n]


def expected(codes, weights, vocabulary: Vocabulary, chances):
    """Expected counts of the pieces in rows that occur `weights` times. chances: by piece, of one language."""
    import numpy as np

    n, found = codes.shape[1], list(vocabulary.edges(codes))
    alpha = np.zeros((n + 1, len(codes)))
    beta = np.zeros((n + 1, len(codes)))
    alpha[0] = beta[n] = 1
    starts: dict[int, list] = {}
    for e in found:
        starts.setdefault(e[0], []).append(e)
    for i in range(n):
        for _, j, rows, pieces in starts.get(i, ()):
            alpha[j, rows] += alpha[i, rows] * chances[pieces]
        alpha[i + 1] += alpha[i] * UNKNOWN
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1] * UNKNOWN
        for _, j, rows, pieces in starts.get(i, ()):
            beta[i, rows] += beta[j, rows] * chances[pieces]
    scale = weights / alpha[n]
    counts = np.zeros(len(chances))
    for i, j, rows, pieces in found:
        counts += np.bincount(pieces, alpha[i, rows] * chances[pieces] * beta[j, rows] * scale[rows], len(chances))
    return counts


def log_sum(x):
    """Logarithm of the sum of exp(x) over the first axis."""
    import numpy as np

    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def log_forward(n: int, edges, logs):
    """What `forward` adds up on the way, for one word of n characters: log probabilities by place and language."""
    import numpy as np

    starts, _, pieces, first = edges
    alone = np.log(UNKNOWN)
    alpha = np.zeros((n + 1, logs.shape[1]))
    for j in range(1, n + 1):
        a, b = first[j], first[j + 1]
        alpha[j] = log_sum(np.concatenate([alpha[j - 1 : j] + alone, alpha[starts[a:b]] + logs[pieces[a:b]]]))
    return alpha


def expected_of(codes, weight: float, vocabulary: Vocabulary, chances):
    """What `expected` gives, for one word of any length."""
    import numpy as np

    n = len(codes)
    starts, ends, pieces, first = vocabulary.edges_of(codes)
    logs = np.log(chances)[:, None]
    alpha = log_forward(n, (starts, ends, pieces, first), logs)
    # backwards: the same on the word's mirror image
    order = np.argsort(-starts, kind="stable")
    mirrored = (n - ends[order], n - starts[order], pieces[order], np.searchsorted(n - starts[order], np.arange(n + 2)))
    beta = log_forward(n, mirrored, logs)[::-1]
    share = np.exp(alpha[starts, 0] + logs[pieces, 0] + beta[ends, 0] - alpha[n, 0])
    return weight * np.bincount(pieces, share, len(chances))


class Model:
    """Languages, log priors, the vocabulary, and the pieces' probabilities in each language."""

    def __init__(self, languages: list[str], priors, vocabulary: Vocabulary, chances):
        self.languages, self.priors, self.vocabulary, self.chances = languages, priors, vocabulary, chances
        self.key = uuid.uuid4().hex


def fit(counts: dict[str, Counter], rows: dict[str, int], vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """From the words of each language and the number of its rows."""
    import numpy as np

    languages = sorted(rows)
    chances = np.full((vocabulary.n, len(languages)), 1 / max(1, vocabulary.n))
    for k, lang in enumerate(languages):
        own = counts.get(lang, {})
        groups = [(vocabulary.codes(g), np.array([own[w] for w in g], float)) for g in by_length(sorted(own))]
        for _ in range(rounds):
            total = np.full(vocabulary.n, SMOOTH)
            for c, n in groups:
                if c.shape[1] <= LONGEST + 1:
                    total += expected(c, n, vocabulary, chances[:, k])
                else:
                    total += sum(expected_of(row, m, vocabulary, chances[:, k]) for row, m in zip(c, n, strict=True))
            chances[:, k] = total / total.sum()
    n = np.array([rows[x] for x in languages], float)
    return Model(languages, np.log(n / n.sum()) if len(n) else n, vocabulary, chances)


def train(docs: DataFrame, learn, model: str, sample: int = SAMPLE) -> Model:
    """Learn from the rows of `docs` (doc_id, text, lang) for which `learn` holds."""
    may = docs.filter(learn & docs["lang"].isNotNull() & docs["doc_id"].isNotNull()).select(docs["doc_id"], docs["lang"], docs["text"])
    rows = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each language
    if not rows:
        return fit({}, {}, Vocabulary.of_model(model))
    place = F.xxhash64("doc_id")
    # places are evenly spread: of a language without repeated doc_ids, many more than `sample` lie below this share
    shares = {lang: min(1.0, (sample + 12 * sample**0.5 + 50) / n) for lang, n in rows.items()}

    def first() -> DataFrame:
        below = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
        near = may.select("doc_id", "lang").filter((place / F.lit(2.0**64) + 0.5) <= below[F.col("lang")])
        order = W.partitionBy("lang").orderBy(place, "doc_id")
        return cut(near.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample).drop("nth"))

    chosen = first()
    found = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if short := [lang for lang, share in shares.items() if share < 1 and found.get(lang, 0) < sample]:
        shares |= dict.fromkeys(short, 1.0)  # repeated doc_ids: all are looked at
        chosen = first()
    texts = may.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(words_of(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    # distinct words of a bounded sample
    counted = mapped(texts.select("lang", "text"), words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for r in counted.toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return fit(counts, rows, Vocabulary.of_model(model))


class Scorer:
    """Log probabilities of the words seen, by language."""

    def __init__(self, model: Model):
        import numpy as np

        self.model = model
        self.known: dict[str, int] = {}
        self.n = 0
        self.logs = np.zeros((1 << 16, len(model.languages)))

    @classmethod
    def of(cls, model: Model) -> Scorer:
        hold("langid", _OPEN.clear)
        if model.key not in _OPEN:
            _OPEN.clear()
            _OPEN[model.key] = cls(model)
        return _OPEN[model.key]

    def learn(self, words: list[str]) -> None:
        import numpy as np

        v, chances = self.model.vocabulary, self.model.chances
        need = self.n + len(words)
        if need > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(need, 2 * len(self.logs)) - len(self.logs), self.logs.shape[1]))])
        for group in by_length(words):
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                if len(some[0]) <= LONGEST:
                    logs = np.log(forward(v.codes(some), v, chances))
                else:
                    logs = [log_forward(len(w) + 1, v.edges_of(v.codes([w])[0]), np.log(chances))[-1] for w in some]
                self.known.update(zip(some, range(self.n, self.n + len(some)), strict=True))
                self.logs[self.n : self.n + len(some)] = logs
                self.n += len(some)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np

        m = self.model
        cut = [words_of(t) if t else [] for t in texts]
        if not m.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self.n >= WORDS_KEPT:
            self.known.clear()
            self.n = 0
        fresh = sorted(set().union(*cut).difference(self.known))
        self.learn(fresh)
        out, scores = [], []
        for words in cut:
            if not words:
                out.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = m.priors + self.logs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            out.append(m.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        for w in fresh:
            if len(w) > LONGEST:
                del self.known[w]
        return out, scores


def identify(docs: DataFrame, model: Model, keep: Sequence[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of `docs`, and for the text the language predicted and its score."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(*(docs[c].alias(f"c{k}") for k, c in enumerate(keep)), text_of(docs).alias("text"))
    schema = StructType([*docs.select(*(docs[c] for c in keep)).schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer.of(shared.value)
        for batch in batches:
            for some in slices(batch, batch.num_columns - 1, BYTES_AT_ONCE):
                lang, score = scorer.score(some.column(some.num_columns - 1).to_pylist())
                columns = [*some.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return mapped(whole, rows, schema)


def remainder(doc_id, of: int):
    """crc32 of the doc_id as text, modulo `of`; null where the doc_id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def learnable(docs: DataFrame):
    return remainder(docs["doc_id"], 5) != 0


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text has letters and whose language is clear: a posterior of `least` or more.

    Where no language could be learned, all rows whose text has letters.
    """
    if not model.languages:
        return docs.filter(text_of(docs).rlike(r"\p{L}"))
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    found = identify(docs, model, docs.columns, (lang, score))
    return found.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = train(docs, learnable(docs), public_tokenizers.path("piece_bpe_32k.model"))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(~learnable(found), F.lit(True)).alias("held_out"), "lang_pred", "score")

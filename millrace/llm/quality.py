"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

The field has two labels and the binary line features of ``line_features``. It is trained here, on the driver, on a
bounded sample of labelled documents (``TRAIN_DOCS``, by a hash of the id). Line labels are latent: the lines of a good
document are content, those of a bad one are first told apart by naive log odds of their features; those that the
odds leave in doubt are then decoded by the field itself in ``ROUNDS`` turns, under the constraint that a bad document has a boilerplate line. So changes of
label inside a document are learnt too. Viterbi decoding gives each line its label, and the share of a text's words in
content lines decides retention; the threshold is calibrated on the held-out fifth of the sample, so that good
documents stay.

For training only, a document is its first ``TRAIN_LINES`` lines, each cut to ``TRAIN_SIGNS`` code points (cut in Spark,
so that the driver holds a bounded sample); scoring reads whole texts.

Defined results: null and empty texts have no words and fail the base rules; without labels the weights of
``PRIOR`` (one prior for each feature) decide; repeated documents are judged each; texts of any length are scored line
by line in memory proportional to the text; ties between labels go to content; an empty table gives no rows; other
columns than doc_id, text and the labels' quality are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, map_rows, small_batches, table

TRAIN_DOCS = 2000
TRAIN_LINES = 60
TRAIN_SIGNS = 2000
ROUNDS, EPOCHS = 3, 60
#: Lines whose log odds are this far from even keep the label that the odds give.
CLEAR = 2.0
#: Content shares that are tried as the threshold, and the share of good documents that must stay.
CUTOFFS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
KEEP_GOOD = 0.995
SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "few_words", "some_words", "symbols", "pipes", "capitals", "bangs", "sentence_end", "repeated_line", "same_words", "digits", "long_words", "entity", "no_vowel_case")
#: Scores of content against boilerplate for each feature, used where there is nothing to train on.
PRIOR = {"bias": 1.5, "few_words": -0.2, "symbols": -4.0, "pipes": -4.0, "capitals": -3.0, "bangs": -3.0, "sentence_end": 0.8, "repeated_line": -0.8, "same_words": -4.0, "digits": -1.0, "long_words": -1.5, "entity": -1.0}


def line_features(line: str, n_words: int, repeated: bool) -> list[float]:
    n = max(n_words, 1)
    words = line.split()
    pipes = line.count("|")
    symbols = sum(map(line.count, SYMBOLS)) - pipes
    letters = sum(map(str.isalpha, line)) if n <= 12 else 0
    upper = line.isupper() if n > 12 else letters > 3 and sum(map(str.isupper, line)) > 0.6 * letters
    return [
        1.0, float(n <= 2), float(3 <= n <= 8), float(symbols > 0.2 * n), float(pipes > 0.2 * n), float(upper), float(line.count("!!") > 0.2 * n),
        float(line.rstrip()[-1:] in ".!?…。"), float(repeated), float(n >= 8 and len(set(words)) < 0.4 * n), float(sum(map(line.count, "0123456789")) > 0.3 * len(line)),
        float(len(line) > 18 * n), float("{" in line or "};" in line or "http" in line), float(n >= 8 and line.islower() and "." not in line),
    ]


def lines_of(text: str) -> tuple[list[tuple[str, int, bool]], int]:
    """(line, words, equal to an earlier line) for each line that has a word, and the number of repeated lines."""
    out, seen, repeats = [], set(), 0
    for line in text.split("\n"):
        if n := len(line.encode().split()):
            again = line in seen
            seen.add(line)
            repeats += again
            out.append((line, n, again))
    return out, repeats


class LineField:
    """Linear-chain field with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None, threshold: float = 0.5):
        if emit is None:
            emit = np.zeros((len(FEATURES), 2))
            for name, score in PRIOR.items():
                emit[FEATURES.index(name), 1] = score
        self.emit, self.move, self.threshold = emit, np.array([[0.5, 0.0], [0.0, 0.5]]) if move is None else move, threshold
        self.gain = (emit[:, 1] - emit[:, 0]).tolist()
        self.steps = [[float(x) for x in row] for row in self.move]

    def decode(self, features: list[list[float]]) -> list[int]:
        """Viterbi: the most probable labels; ties go to content."""
        (m00, m01), (m10, m11) = self.steps
        gain, back = self.gain, []
        a = b = 0.0
        for i, f in enumerate(features):
            g = 0.0
            for w, x in zip(gain, f, strict=True):
                if x:
                    g += w * x
            if i:
                to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
                back.append((to0[1] >= to0[0], to1[1] >= to1[0]))
                a, b = max(to0), max(to1)
            b += g
        labels = [int(b >= a)] if features else []
        for pair in reversed(back):
            labels.append(int(pair[labels[-1]]))
        return labels[::-1]

    def label(self, lines: list[tuple[str, int, bool]]) -> list[int]:
        return self.decode([line_features(*x) for x in lines])

    def share(self, lines: list[tuple[str, int, bool]]) -> float:
        return content_share(lines, self.label(lines))

    @classmethod
    def train(cls, texts: list[str], good: list[int]) -> LineField:
        """Hard expectation and maximisation: line labels of bad documents, then the field that fits them, in turns."""
        kept = [(lines[:TRAIN_LINES], y) for t, y in zip(texts, good, strict=True) if (lines := lines_of(t)[0])]
        held, used = kept[::5], [x for i, x in enumerate(kept) if i % 5]
        if len({y for _, y in used}) < 2:
            return cls()
        n, t, k = len(used), max(len(x) for x, _ in used), len(FEATURES)
        x, mask, y = np.zeros((n, t, k)), np.zeros((n, t), bool), np.array([y for _, y in used])
        for i, (lines, _) in enumerate(used):
            x[i, : len(lines)] = [line_features(*line) for line in lines]
            mask[i, : len(lines)] = True
        labels = np.ones((n, t), np.int64)
        seen = [(x[y == v].sum((0, 1)) + 1) / (mask[y == v].sum() + 2) for v in (0, 1)]
        odds = x @ (np.log(seen[1]) - np.log(seen[0]))
        labels[y == 0] = odds[y == 0] >= 0
        first, clear = labels.copy(), np.abs(odds) >= CLEAR
        field = None
        for turn in range(ROUNDS):
            if turn:
                odds = x @ np.array(field.gain)
                for i in np.flatnonzero(y == 0):
                    m = int(mask[i].sum())
                    labels[i, :m] = np.where(clear[i, :m], first[i, :m], field.decode(x[i, :m].tolist()))
            for i in np.flatnonzero((y == 0) & (labels.astype(bool) | ~mask).all(1)):
                m = int(mask[i].sum())
                labels[i, int(odds[i, :m].argmin())] = 0
            field = cls(*_fit(x, mask, labels, y, field))
        shares = [(field.share(lines), y) for lines, y in held]
        good_n, bad_n = max(1, sum(y for _, y in shares)), max(1, sum(1 - y for _, y in shares))
        best = (-1.0, 0.0)
        for cutoff in CUTOFFS:
            keeps = sum(y for s, y in shares if s >= cutoff) / good_n
            drops = sum(1 - y for s, y in shares if s < cutoff) / bad_n
            if keeps >= KEEP_GOOD or cutoff == CUTOFFS[0]:
                best = max(best, (2 * keeps + drops, -cutoff))
        field.threshold = -best[1]
        return field


def content_share(lines: list[tuple[str, int, bool]], labels: list[int]) -> float:
    """Share of the words that stand in content lines."""
    total = sum(n for _, n, _ in lines)
    return sum(n for (_, n, _), y in zip(lines, labels, strict=True) if y) / total if total else 0.0


def _fit(x: np.ndarray, mask: np.ndarray, labels: np.ndarray, good: np.ndarray, start: LineField | None, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition scores of the penalised likelihood's maximum: gradient ascent (Adam), forward and backward in logs.

    Documents count alike within their class and classes alike, whatever their numbers of lines.
    """
    n, t, k = x.shape
    weight = np.where(good == 1, 0.5 / max((good == 1).mean(), 1e-9), 0.5 / max((good == 0).mean(), 1e-9))
    size = weight / mask.sum(1)
    pair = (mask[:, 1:] & mask[:, :-1]) * size[:, None]
    truth = np.stack([labels == 0, labels == 1], 2) * (mask * size[:, None])[:, :, None]
    emitted = np.einsum("ntk,nty->ky", x, truth)
    moved = np.array([[(pair * (labels[:, :-1] == a) * (labels[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    theta = np.zeros(k * 2 + 4) if start is None else np.concatenate([start.emit.ravel(), start.move.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        emit, move = theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2)
        score = x @ emit
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = score[:, 0]
        for j in range(1, t):
            came = np.logaddexp(fwd[:, j - 1, :1] + move[0], fwd[:, j - 1, 1:] + move[1])
            fwd[:, j] = np.where(mask[:, j, None], score[:, j] + came, fwd[:, j - 1])
        for j in range(t - 2, -1, -1):
            after = score[:, j + 1] + bwd[:, j + 1]
            bwd[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1]), bwd[:, j + 1])
        log_z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        one = np.exp(fwd + bwd - log_z[:, None, None]) * (mask * size[:, None])[:, :, None]
        two = np.exp(fwd[:, :-1, :, None] + move + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - log_z[:, None, None, None]) * pair[:, :, None, None]
        g = np.concatenate([(emitted - np.einsum("ntk,nty->ky", x, one)).ravel(), (moved - two.sum((0, 1))).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2)


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29)))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, list]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines."""
    words = text.encode().split()
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines, repeats = lines_of(text)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), repeats, repeat_words(words), lines


def training_sample(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """About ``limit`` labelled documents, by a hash of the id; of each the first lines, cut in Spark."""
    chosen = bounded_sample(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality"), ["doc_id"], limit)
    by_id = {r.doc_id: int(r.quality) for r in chosen}
    cut = F.transform(F.slice(F.split("text", "\n"), 1, 2 * TRAIN_LINES), lambda x: F.substring(x, 1, TRAIN_SIGNS))
    rows = documents.where(F.col("doc_id").isin(list(by_id)) & F.col("text").isNotNull()).select("doc_id", F.array_join(cut, "\n").alias("text")).limit(2 * limit).collect() if by_id else []
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [by_id[r.doc_id] for r in rows]


def score_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """The contract's columns, the content share, and the numbers of lines with words and of content lines of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)

    def load():
        model = shared.value

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                n, chars, symbols, dup, rep, lines = base_counts(text or "")
                failed = n < 20 or 100 * rep > 30 * n
                labels = model.label(lines)
                share = content_share(lines, labels)
                yield doc_id, n, chars, symbols, dup, rep, failed, not failed and share >= model.threshold, share, len(lines), sum(labels)

        return step

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
    return map_rows(docs.select("doc_id", "text"), schema, load)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and the field's verdict."""
    documents = table(spark, sf_dir, "documents")
    field = LineField.train(*training_sample(documents, table(spark, sf_dir, "labels")))
    return score_documents(documents, field)

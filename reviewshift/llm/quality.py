"""Document quality from a linear-chain conditional random field over lines.

Every line is a node with two labels, bad and good. A line's features are counts of its own
letters and words and those of the lines before and after it; a 2 x 2 table weighs neighbouring
labels. Forward-backward gives each line's marginal of "good"; their mean, weighted by line length,
goes through a logistic curve fitted on the same sample to a score from 0 to 1.

``fit`` learns from a bounded sample of labelled rows: the ``max_docs`` ids of each label that
come first by a hash, and of each the first ``max_lines`` lines (as training data
only; scores use whole texts). Each line of a training document has its document's label.

Defined results: null and empty texts are one empty line and get a score. Null labels are not
learned from. With one label only (or none), every score is that label's share (or 0.5).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, let, texts_of

CHUNK_CHARS = 1_000_000  # texts that are scored at once (one text at least)
#: Classes of bytes, by table: upper, lower, digit, white space, sentence marks, other marks, high.
N_CLASSES = 7


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)
    kind[ord("A"):ord("Z") + 1], kind[ord("a"):ord("z") + 1], kind[ord("0"):ord("9") + 1] = 0, 1, 2
    for c in b" \t\n\r\x0b\x0c":
        kind[c] = 3
    for c in b".,;:?'\"()-":
        kind[c] = 4
    kind[0x80:] = 6
    return kind


BYTE_CLASS = _byte_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of ``texts`` with its neighbours', line sizes in bytes, and the
    number of lines of each text."""
    lines: list[bytes] = []
    each = np.empty(len(texts), np.int64)
    words, kinds, shouts, again = [], [], [], []
    for k, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").split(b"\n")
        each[k] = len(own)
        seen: set[bytes] = set()
        for line in own:
            parts = line.split()
            words.append(len(parts))
            kinds.append(len(set(parts)))
            shouts.append(line.count(b"!"))
            again.append(line in seen)
            seen.add(line)
        lines += own
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = BYTE_CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    line = np.repeat(np.arange(len(lines)), size)
    counts = np.bincount(line * N_CLASSES + flat, minlength=len(lines) * N_CLASSES).reshape(-1, N_CLASSES)
    n_words, n_kinds = np.array(words, float), np.array(kinds, float)
    one = np.column_stack([
        counts / np.maximum(size, 1)[:, None],
        np.array(shouts) / np.maximum(n_words, 1),
        counts[:, 5] / np.maximum(n_words, 1),
        np.where(n_words > 1, n_kinds / np.maximum(n_words, 1), 1.0),
        np.minimum(np.log1p(n_words), 6) / 6,
        np.minimum(np.log1p(size / np.maximum(n_words, 1)), 6) / 6,
        np.array(again, float), size == 0,
    ]).astype(np.float32)
    before, after = np.zeros_like(one), np.zeros_like(one)
    before[1:], after[:-1] = one[:-1], one[1:]
    first = np.cumsum(each) - each
    before[first], after[first + each - 1] = 0, 0
    edge = np.zeros((len(lines), 2), np.float32)
    edge[first, 0], edge[first + each - 1, 1] = 1, 1
    return np.hstack([one, before, after, edge, np.ones((len(lines), 1), np.float32)]), size, each


def marginals(good: np.ndarray, step: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of ``each`` lines that lie one after another.

    ``good`` is each line's weight of label good (that of bad is 0), ``step`` the 2 x 2 weights of
    neighbouring labels. Returns the marginals of good, the expected label pairs (2 x 2, summed)
    and log Z of each chain. Chains are walked side by side, the longest first.
    """
    order = np.argsort(-each, kind="stable")
    first, sizes = (np.cumsum(each) - each)[order], each[order]
    node = np.zeros((len(good), 2))
    node[:, 1] = good
    fore, back, log_z = np.empty((len(good), 2)), np.zeros((len(good), 2)), np.zeros(len(each))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains that have line t
    both = lambda x: np.logaddexp(x[:, 0], x[:, 1])
    for t in range(longest):
        at = first[:alive[t]] + t
        fore[at] = node[at]
        if t:
            fore[at] += both(fore[at - 1][:, :, None] + step)
    for t in range(longest - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        nxt = (node[at + 1] + back[at + 1])[:, None, :] + step
        back[at] = np.logaddexp(nxt[:, :, 0], nxt[:, :, 1])
    ends = first + sizes - 1
    log_z[order] = both(fore[ends])
    z = np.repeat(log_z, each)
    prob = np.exp(fore[:, 1] + back[:, 1] - z)
    inner = np.ones(len(good), bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(fore[at][:, :, None] + step + (node[at + 1] + back[at + 1])[:, None, :]
                   - z[at][:, None, None]).sum(axis=0)
    return prob, pairs, log_z


@dataclass(frozen=True)
class LineCrf:
    weights: np.ndarray  # of the features, for label good
    step: np.ndarray     # of neighbouring labels
    curve: tuple[float, float]  # of the score

    def line_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, size, each = line_features(texts)
        return marginals(x @ self.weights, self.step, each)[0], size, each

    def raw(self, texts: list[str]) -> np.ndarray:
        """Mean marginal of each text, weighted by line length."""
        prob, size, each = self.line_marginals(texts)
        first = np.cumsum(each) - each
        return np.add.reduceat(prob * (size + 1), first) / np.add.reduceat(size + 1.0, first)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return _sigmoid(a * _logit(self.raw(texts)) + b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.15, l2: float = 1e-4) -> LineCrf:
    """Maximum likelihood by Adam. The lines of either label weigh the same in all."""
    y = np.array(labels, np.int64)
    n_features = line_features([""])[0].shape[1]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return LineCrf(np.zeros(n_features), np.zeros((2, 2)), (0.0, float(_logit(np.array(share)))))
    sides = []  # of each label: features, lines of each chain, weight of a line
    for k in (0, 1):
        x, _, each = line_features([t for t, own in zip(texts, y) if own == k])
        sides.append((x.astype(float), each, 0.5 / each.sum()))
    theta = np.zeros(n_features + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        grad = l2 * theta
        for k, (x, each, weight) in enumerate(sides):
            prob, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), each)
            pairs[k, k] -= (each - 1).sum()
            grad[:-4] += weight * (x.T @ (prob - k))
            grad[-4:] += weight * pairs.ravel()
        mean = 0.9 * mean + 0.1 * grad
        var = 0.999 * var + 0.001 * grad * grad
        theta -= rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.999 ** t)) + 1e-8)
    plain = LineCrf(theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    raw = _logit(plain.raw(texts))
    a, b = 1.0, 0.0
    for _ in range(500):  # the curve: weighted logistic regression on one input
        miss = (_sigmoid(a * raw + b) - y) * np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        a, b = a - 0.1 * (miss @ raw + 1e-3 * a), b - 0.1 * miss.sum()
    return LineCrf(plain.weights, plain.step, (float(a), float(b)))


def stretch(text: Column, key: Column, max_lines: int, max_chars: int) -> Column:
    """``text``, or of a longer one a contiguous stretch of ``max_lines`` lines, and of those ``max_chars`` characters;
    where it begins is a hash of ``key``, so that every place of a text can be drawn."""
    def lines(own):
        over = F.greatest(F.size(own) - max_lines, F.lit(0))
        return F.array_join(F.slice(own, F.pmod(F.xxhash64(key), over + 1).cast("int") + 1, max_lines), "\n")

    def letters(own):
        over = F.greatest(F.length(own) - max_chars, F.lit(0))
        return F.substring(own, F.pmod(F.xxhash64(key, F.lit(1)), over + 1).cast("int") + 1, F.lit(max_chars))

    return let(let(F.split(text, "\n"), lines), letters)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_docs: int = 1500, max_lines: int = 60, max_chars: int = 24_000) -> LineCrf:
    """A model of at most ``max_docs`` ids of each label, the first by a hash of the id. Of each, a stretch
    of at most ``max_lines`` lines and ``max_chars`` characters at a hashed place reaches the driver; equal
    texts count once. The ids are drawn from ``labels`` alone, so no text is shuffled to find its label."""
    marked = (labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
              .filter(F.col("i").isNotNull() & F.col("y").isin(0, 1)).groupBy("i").agg(F.max("y").alias("y")))
    drawn = {r["i"]: k for k in (0, 1)
             for r in marked.filter(F.col("y") == k).orderBy(F.xxhash64("i"), "i").limit(max_docs).collect()}
    if not drawn:
        return train([], [])
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in drawn], marked.select("i").schema))
    rows = (docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(ids, "i", "left_semi")
            .select("i", stretch(F.coalesce("text", F.lit("")), F.col("i"), max_lines, max_chars).alias("t"))
            .groupBy("i").agg(F.min("t").alias("t")).collect())
    once = sorted({(r["t"], drawn[r["i"]]) for r in rows})
    return train([t for t, _ in once], [y for _, y in once])


def add_scores(docs: DataFrame, model: LineCrf, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus the score of every whole text; no shuffle."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        scores, part, held = [np.zeros(0)], [], 0
        for t in texts_of(b.column(0)):
            part.append(t)
            held += len(t)
            if held >= CHUNK_CHARS:
                scores.append(model.score(part))
                part, held = [], 0
        if part:
            scores.append(model.score(part))
        return {out: pa.array(np.concatenate(scores))}

    return append_columns(docs, run, {out: T.DoubleType()}, {"text": text_col})

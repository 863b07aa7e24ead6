"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import fresh, over_batches

#: Byte classes of the features.
SPACE, LOWER, UPPER, DIGIT, STOP, SIGN, BAR, SHOUT, LEAD, REST = range(10)
#: Features of a line itself, and which of them are also taken from its neighbours.
OWN = 13
SHARED = slice(3, 11)
WIDTH = OWN + 2 * (SHARED.stop - SHARED.start)


def _classes() -> np.ndarray:
    table = np.full(256, REST, np.uint8)
    for kind, chars in ((SPACE, b" \t\n\x0b\x0c\r"), (STOP, b".,;:?"), (SIGN, b"#$%&*"), (BAR, b"|"), (SHOUT, b"!")):
        table[list(chars)] = kind
    table[97:123], table[65:91], table[48:58], table[0xC0:] = LOWER, UPPER, DIGIT, LEAD
    return table


CLASSES = _classes()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features [line, WIDTH] and byte lengths of the lines of a whole text.

    Lines end at a newline. An empty text is one empty line. The features of a line are shares
    of kinds of characters, marks per word, and repeated words; those of the lines before and
    after follow (zeros at the ends).
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    kind = CLASSES[raw]
    begins = np.append(0, np.flatnonzero(raw == 10) + 1)
    padded = np.append(kind, SPACE)

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return (sums[np.append(begins[1:], len(raw))] - sums[begins]).astype(float)

    count = {k: per_line(kind == k) for k in range(9)}
    sizes = np.diff(np.append(begins, len(raw))).astype(float)
    starts = (kind != SPACE) & (np.append(SPACE, kind)[:-1] == SPACE)
    words = per_line(starts)
    tokens = data.split()
    marks = np.fromiter(map(hash, tokens), np.int64, len(tokens))
    again = np.zeros(len(raw), bool)
    if len(marks) > 1:
        again[np.flatnonzero(starts)[1:][marks[1:] == marks[:-1]]] = True
    letters = count[LOWER] + count[UPPER] + count[LEAD]
    visible = np.maximum(sizes - count[SPACE], 1)
    each = np.maximum(words, 1)
    ends = np.append(begins[1:] - 1, len(raw))
    own = np.stack([
        np.ones(len(begins)), np.log1p(sizes) / 5, np.log1p(words) / 3, letters / visible,
        count[UPPER] / np.maximum(letters, 1), count[DIGIT] / visible, np.minimum(count[SIGN] / each, 3),
        np.minimum(count[BAR] / each, 3), np.minimum(count[SHOUT] / each, 3), np.minimum(count[STOP] / each, 3),
        per_line(again) / each, padded[np.maximum(ends - 1, 0)] == STOP,
        np.isin(padded[begins], (UPPER, LEAD)),
    ], axis=1)
    near = own[:, SHARED]
    none = np.zeros((1, near.shape[1]))
    return np.hstack([own, np.vstack([none, near[:-1]]), np.vstack([near[1:], none])]), sizes


class Model:
    """Weights of the label good (bad has none), and scores of going from label to label.

    `scale` turns a document's weighted mean m into a probability: 1 / (1 + exp(-(a m + b))).
    """

    def __init__(self, weights: np.ndarray, moves: np.ndarray, scale: tuple[float, float] = (0.0, 0.0)):
        self.weights, self.moves, self.scale = weights, moves, scale

    def document(self, good: np.ndarray, sizes: np.ndarray) -> float:
        """The probability of a document from P(good) and the byte lengths of its lines."""
        a, b = self.scale
        return float(1 / (1 + np.exp(-(a * weighted_mean(good, sizes) + b))))


def weighted_mean(good: np.ndarray, sizes: np.ndarray) -> float:
    return float(good @ (sizes + 1) / (sizes + 1).sum())


def marginals(model: Model, features: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """P(good) of each line of each document, pair marginals summed, and log partition sums.

    Forward-backward runs over all documents side by side, line by line, longest first, so
    that what is left to do shrinks with each step.
    """
    order = sorted(range(len(features)), key=lambda n: -len(features[n]))
    sizes = np.array([len(features[n]) for n in order])
    offsets = np.append(0, np.cumsum(sizes))
    local = np.zeros((offsets[-1], 2))
    local[:, 1] = np.concatenate([features[n] for n in order]) @ model.weights
    steps = int(sizes[0])
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]
    alpha, beta = np.empty_like(local), np.zeros_like(local)
    at = offsets[:-1]
    alpha[at] = local[at]
    for t in range(1, steps):
        now = at[: active[t]] + t
        alpha[now] = local[now] + _over(alpha[now - 1][:, :, None] + model.moves, 1)
    for t in range(steps - 1, 0, -1):
        now = at[: active[t]] + t
        beta[now - 1] = _over(model.moves + (local[now] + beta[now])[:, None, :], 2)
    total = _over(alpha[offsets[1:] - 1], 1)
    of = np.repeat(np.arange(len(order)), sizes)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - total[of], 0))
    inner = np.setdiff1d(np.arange(len(local)), at, assume_unique=True)
    pairs = np.exp(
        alpha[inner - 1][:, :, None] + model.moves + (local[inner] + beta[inner])[:, None, :]
        - total[of[inner]][:, None, None]
    ).sum(axis=0)
    out: list[np.ndarray] = [None] * len(order)
    for k, n in enumerate(order):
        out[n] = good[offsets[k] : offsets[k + 1]]
    return out, pairs, total


def _over(values: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(values, axis=axis)


def learn(features: list[np.ndarray], labels: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> Model:
    """Weights that make each document's label likely on all of its lines (Adam on the likelihood)."""
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if not len(features):
        return Model(weights, moves)
    lines = np.concatenate(features)
    sizes = np.array([len(f) for f in features])
    truth = np.repeat(labels, sizes).astype(float)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (sizes[labels == label] - 1).sum()
    point, first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for turn in range(1, rounds + 1):
        model = Model(point[:WIDTH], point[WIDTH:].reshape(2, 2))
        good, pairs, _ = marginals(model, features)
        slope = np.concatenate([lines.T @ (truth - np.concatenate(good)), (seen - pairs).ravel()]) / len(lines)
        slope -= penalty * point
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        point = point + 0.15 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    model = Model(point[:WIDTH], point[WIDTH:].reshape(2, 2))
    good, _, _ = marginals(model, features)
    means = np.array([weighted_mean(p, np.expm1(5 * f[:, 1])) for p, f in zip(good, features, strict=True)])
    return Model(model.weights, model.moves, _scaled(means, labels))


def _scaled(means: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Logistic regression of the label on one number, by Newton steps with a small penalty."""
    x = np.stack([means, np.ones(len(means))], axis=1)
    point = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ point, -30, 30)))
        slope = x.T @ (labels - p) - 0.05 * point
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        point = point + np.clip(np.linalg.solve(bend, slope), -5, 5)
    return float(point[0]), float(point[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_docs: int = 3_000,
    fit_lines: int = 100,
) -> Model:
    """Learn from labelled documents; labels are 0 or 1, others and nulls don't count.

    About `fit_docs` rows of `labels` are used, picked by a hash of the id (all, if fewer), of
    documents with at most `fit_lines` lines; only their line features come to the driver, at
    most fit_docs * fit_lines rows. Without any such row all weights are zero.
    """
    good = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")
    )
    share = min(1.0, fit_docs / max(good.count(), 1))
    picked = F.pmod(F.xxhash64("label_id", F.lit(10)), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = (good.where(picked) if share < 1 else good).limit(2 * fit_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    few = F.length("text") - F.length(F.replace("text", F.lit("\n"))) < fit_lines
    rows = texts.where(few).join(F.broadcast(sample), "label_id").select("label_id", "label", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [line_features(t.as_py())[0].astype(np.float32).tobytes() for t in batch.column(2)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "label", "features"]
        )

    found = sorted(over_batches(rows, work, "id long, label int, features binary").collect())
    features = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH).astype(float) for r in found]
    return learn(features, np.array([r[1] for r in found], int))


def score(
    docs: DataFrame, model: Model, text_col: str = "text", score_name: str = "score", lines_name: str | None = None
) -> DataFrame:
    """`docs` with `score`: the length-weighted mean of P(good) over all lines, as a probability.

    Null and empty texts count as one empty line. With `lines_name`, a column of that name has
    P(good) of each line. Whole texts are read; rows need no shuffle; other columns stay, except
    ones of these names, which are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves, model.scale))
    adds = {score_name: "double"} | ({lines_name: "array<double>"} if lines_name else {})
    (given,) = fresh(docs, "given")
    kept = [c for c in docs.columns if c not in adds]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(given))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{n}` {t}" for n, t in adds.items())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = Model(*sent.value)
        scores, lines, part, size = [], [], [], 0

        def flush():
            good, _, _ = marginals(model, [f for f, _ in part])
            for p, (_, n) in zip(good, part, strict=True):
                scores.append(model.document(p, n))
                if lines_name:
                    lines.append(p.tolist())

        for text in batch.column(batch.schema.get_field_index(given)):
            part.append(line_features(text.as_py()))
            size += len(part[-1][1])
            if size >= 1 << 16:
                flush()
                part, size = [], 0
        if part:
            flush()
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        made = [pa.array(scores, pa.float64())] + ([pa.array(lines, pa.list_(pa.float64()))] if lines_name else [])
        return pa.RecordBatch.from_arrays([*columns, *made], [*kept, *adds])

    return over_batches(rows, work, schema)

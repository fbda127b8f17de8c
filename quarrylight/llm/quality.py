"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that together cover all of it. Each byte is looked up in a learned
embedding; a byte that starts a run already seen a few bytes before (a stuttered word) uses a second row of its own.
Learned filters slide over each chunk, their rectified responses are max-pooled over the chunk, and the chunks' pooled
responses are combined by maximum and mean into one logistic unit.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 2
DIM = 6
FILTERS = 16
#: Lags at which a run of RUN equal bytes marks a stutter.
LAGS = range(2, 33)
RUN = 12
THRESHOLD = 0.3
#: Bounds of the training sample: labelled rows, and bytes of their texts, which count whole.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 12 << 20
#: Passes over the sample at most; a large one gets fewer, about STEPS batches in all.
EPOCHS = 12
STEPS = 800
#: Chunks that go through the filters at once, and the bytes from which a text is read in such blocks.
BLOCK = 64
LONG = 1 << 18


def symbols(data: bytes) -> np.ndarray:
    """A number from 0 to 511 for each byte: the byte, plus 256 where RUN bytes from here repeat those some LAG before. Padded to one chunk at least with 0 bytes."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < CHUNK:
        x = np.concatenate([x, np.zeros(CHUNK - len(x), np.uint8)])
    n = len(data)
    seen = np.zeros(len(x), bool)
    for lag in LAGS:
        if n < lag + RUN:
            break
        same = x[lag:n] == x[: n - lag]
        two = same[:-1] & same[1:]
        four = two[:-2] & two[2:]
        seen[lag : lag + len(four) - 8] |= four[:-8] & four[4:-4] & four[8:]
    return x.astype(np.int16) + seen.astype(np.int16) * 256


def _starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes begin: every byte is in one at least, the last one ends with the text."""
    last = max(n, CHUNK) - CHUNK
    return np.append(np.arange(0, last, CHUNK - OVERLAP), last)


def chunk_blocks(data: bytes, block: int = 1024):
    """The chunks of a text, (up to ``block``, CHUNK) at a time, so that what is held does not grow with it."""
    starts = _starts(len(data))
    for k in range(0, len(starts), block):
        own = starts[k : k + block]
        first, end = int(own[0]), int(own[-1]) + CHUNK
        low, high = max(0, first - LAGS[-1]), end + RUN - 1  # what a byte's symbol depends on
        s = symbols(data[low:high])[first - low : end - low]
        yield np.lib.stride_tricks.sliding_window_view(s, CHUNK)[own - first]


def chunks(data: bytes) -> np.ndarray:
    """(chunks, CHUNK): all of them."""
    return np.concatenate(list(chunk_blocks(data)))


@dataclass
class QualityModel:
    embedding: np.ndarray  # (512, DIM)
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    filter_bias: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,): of the maxima, of the means
    bias: float

    def responses(self, c: np.ndarray) -> np.ndarray:
        """(chunks, positions, FILTERS) before rectifying."""
        e = self.embedding[c]
        s = e.strides
        places = (CHUNK - WIDTH) // STRIDE + 1
        windows = np.lib.stride_tricks.as_strided(e, (len(c), places, WIDTH * DIM), (s[0], s[1] * STRIDE, s[2]))
        return windows.reshape(-1, WIDTH * DIM) @ self.filters + self.filter_bias

    def pooled(self, c: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): each filter's largest rectified response in each chunk, BLOCK chunks at a time."""
        return np.concatenate([np.maximum(self.responses(c[k : k + BLOCK]).reshape(len(c[k : k + BLOCK]), -1, FILTERS).max(1), 0) for k in range(0, len(c), BLOCK)])

    def probability(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([top, mean], 1).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score_long(self, data: bytes) -> float:
        """score_all() of one text, block by block."""
        top, total, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
        for c in chunk_blocks(data):
            h = self.pooled(c)
            top, total, n = np.maximum(top, h.max(0)), total + h.sum(0, np.float64), n + len(h)
        return float(self.probability(top[None], total[None] / n)[0])

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1; the chunks of many short texts go through the filters together."""
        out = np.zeros(len(texts))
        parts, of = [], []
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "replace")
            if len(data) >= LONG:
                out[i] = self.score_long(data)
            else:
                parts.append(chunks(data))
                of.append(i)
        if parts:
            h = self.pooled(np.concatenate(parts))
            first = np.cumsum([0] + [len(p) for p in parts[:-1]])
            out[of] = self.probability(np.maximum.reduceat(h, first), np.add.reduceat(h, first) / np.array([len(p) for p in parts])[:, None])
        return out

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, embedding=self.embedding, filters=self.filters, filter_bias=self.filter_bias, weights=self.weights, bias=self.bias)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> QualityModel:
        got = np.load(io.BytesIO(data))
        return cls(*(got[n] for n in ("embedding", "filters", "filter_bias", "weights")), float(got["bias"]))


def initial(seed: int = 7) -> QualityModel:
    r = np.random.default_rng(seed)
    return QualityModel(r.normal(0, 0.5, (512, DIM)).astype(np.float32), r.normal(0, 0.25, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7, batch: int = 32, rate: float = 0.01) -> QualityModel:
    """Adam on the log loss. Only a chunk's position with the largest response passes a gradient back, so the backward pass touches one window per chunk and filter."""
    m, r = initial(seed), np.random.default_rng(seed)
    y_all = np.array(labels, np.float64)
    if not len(y_all):
        return m
    m.bias = float(np.log((y_all.sum() + 1) / (len(y_all) - y_all.sum() + 1)))
    m.weights = r.normal(0, 0.3, 2 * FILTERS)
    if y_all.min() == y_all.max():
        m.weights[:] = 0
        return m
    parts = [chunks((t or "").encode("utf-8", "replace")) for t in texts]
    names = ("embedding", "filters", "filter_bias", "weights", "bias")
    moments = {n: [0.0, 0.0] for n in names}
    step = 0
    epochs = min(epochs, -(-STEPS // -(-len(parts) // batch)))
    for epoch in range(epochs):
        order = r.permutation(len(parts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            sizes = np.array([len(parts[i]) for i in own])
            first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(own)), sizes)
            c = np.concatenate([parts[i] for i in own])
            at, h = np.zeros((len(c), FILTERS), np.int64), np.zeros((len(c), FILTERS), np.float32)
            for j in range(0, len(c), BLOCK):  # what the forward pass holds does not grow with the texts
                resp = m.responses(c[j : j + BLOCK]).reshape(len(c[j : j + BLOCK]), -1, FILTERS)
                at[j : j + BLOCK], h[j : j + BLOCK] = resp.argmax(1), np.maximum(resp.max(1), 0)
            top = np.maximum.reduceat(h, first)
            mean = np.add.reduceat(h, first) / sizes[:, None]
            x = np.concatenate([top, mean], 1)
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -60, 60)))
            dz = (p - y_all[own]) / len(own)
            dx = dz[:, None] * m.weights
            dh = (dx[of, FILTERS:] / sizes[of, None] + np.where(h == top[of], dx[of, :FILTERS], 0)) * (h > 0)
            places = at[:, :, None] * STRIDE + np.arange(WIDTH)  # chunks, filters, width
            sym = c[np.arange(len(c))[:, None, None], places]
            win = m.embedding[sym].reshape(len(c), FILTERS, -1)
            dwin = (dh[:, :, None] * m.filters.T[None]).reshape(-1, DIM)
            de = np.zeros_like(m.embedding)
            np.add.at(de, sym.reshape(-1), dwin)
            grads = {"embedding": de, "filters": np.einsum("cf,cfw->wf", dh, win), "filter_bias": dh.sum(0), "weights": x.T @ dz + 1e-4 * m.weights, "bias": dz.sum()}
            step += 1
            speed = rate * (1 if epoch < epochs * 0.7 else 0.3)
            for n in names:
                a, b = moments[n] = [0.9 * moments[n][0] + 0.1 * grads[n], 0.999 * moments[n][1] + 0.001 * grads[n] ** 2]
                move = speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                old = getattr(m, n)
                setattr(m, n, float(old - move) if n == "bias" else (old - move).astype(old.dtype))
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Trains on the whole texts of at most ``sample_rows`` labelled ids, those with the smallest hash, as far as they fit ``sample_bytes`` bytes together.

    Null ids and labels are left out, as are ids whose labels differ; an id with several texts counts once, with the one of
    the smallest hash. The network is trained in one task, to which only the sample goes; the driver gets at most
    ``sample_rows`` ids and sizes, and the model. Without labelled rows the model gives 0.5.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("other")).where("y = other").select("id", "y")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = texts.select("id", F.struct(F.xxhash64("text").alias("th"), F.octet_length("text").alias("size")).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    drawn = named.join(sizes, "id").select("id", "y", "x.*").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    picked, left = [], sample_bytes
    for r in drawn:
        if r["size"] <= left:
            picked.append((r["id"], r["th"], r["y"]))
            left -= r["size"]
    if not picked:
        return initial()
    wanted = spark.createDataFrame(picked, f"id {kind}, th long, y int")  # sample_rows rows at most
    sample = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "th"]).groupBy("id").agg(F.first("text").alias("text"), F.first("y").alias("y"))

    def run(batches):
        rows = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))), key=lambda r: str(r[0]))
        yield pa.RecordBatch.from_arrays([pa.array([train([r[1] for r in rows], [r[2] for r in rows]).packed()], pa.binary())], names=["model"])

    return QualityModel.unpacked(sample.repartition(1).mapInArrow(run, "model binary").collect()[0]["model"])


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``score``, ``predicted``: one row per row of ``df``; whole texts count, null ones as empty. No other column is read or carried."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = scores(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def scores(model: QualityModel, texts: list[str | None], group_chars: int = 200_000) -> np.ndarray:
    """score_all() over groups of texts of about ``group_chars`` characters."""
    out, group, size = [np.zeros(0)], [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= group_chars:
            out.append(model.score_all(group))
            group, size = [], 0
    return np.concatenate([*out, model.score_all(group)])


def keep_good(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all its columns, that the model does not reject."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(model, b.column(at).to_pylist()) >= threshold))

    return df.mapInArrow(run, df.schema)

"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved by learned filters of WIDTH
bytes at every STRIDE-th byte; filter outputs are max-pooled over overlapping
chunks of CHUNK bytes, each half a chunk after the other, so every byte of the
whole text is seen. A hidden layer reads each chunk; its units are max-pooled
and averaged over the chunks, and a logistic unit combines both into one
probability. For scoring, embedding and filters are folded into one table row
per byte value and filter position.

Training is by Adam on the driver, on a bounded sample of labelled rows: those of
least seeded hash, at most ``max_train`` of them and at most ``max_bytes`` bytes of
text together (a row that would pass that is not in the sample). Texts of the
sample are read whole, and so is every text that is scored. Labels and other
columns are never inputs. Classes weigh by their numbers and LEAN, and
predictions are cut at 0.7.

A null or empty text is scored as an empty chunk. Rows without a label are
scored like all others; labels for unknown documents or null labels are not
used; of several labels of one document the largest counts, of several texts of
one the first by its hash. Without labelled rows of both classes every score is 0.5, no
row is predicted good, and keep_good keeps all. Repeated rows get equal scores, an
empty table none. Columns of docs named like a result are replaced in the scored
table; keep_good leaves all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Steps, prepare

WIDTH, STRIDE, CHUNK = 8, 2, 256
EMBED, FILTERS, HIDDEN = 8, 24, 16
HALF = CHUNK // 2 // STRIDE  # filter positions in half a chunk
THRESHOLD = 0.7
#: Of the sample: rows, and bytes of text together.
MAX_TRAIN, MAX_BYTES = 3000, 24 << 20
#: Rows looked at in training, repeats counted (6 to 40 epochs).
VISITS = 18_000
#: A good document weighs this many times a bad one, so that few good ones are lost at the threshold.
LEAN = 2.5
BLOCK = 64  # half chunks that are convolved at once


@dataclass
class Network:
    emb: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDTH * EMBED x FILTERS
    conv_b: np.ndarray
    hid: np.ndarray  # FILTERS x HIDDEN
    hid_b: np.ndarray
    out: np.ndarray  # 2 * HIDDEN: of the maxima, of the means
    out_b: np.ndarray

    @staticmethod
    def fresh(seed: int = 4) -> Network:
        g = np.random.default_rng(seed)
        n = lambda *s, scale: g.normal(0, scale, s).astype(np.float32)
        return Network(n(256, EMBED, scale=0.5), n(WIDTH * EMBED, FILTERS, scale=(2 / WIDTH / EMBED) ** 0.5), np.zeros(FILTERS, np.float32), n(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), n(2 * HIDDEN, scale=0.2), np.zeros(1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.conv_b, self.hid, self.hid_b, self.out, self.out_b]

    def tables(self) -> np.ndarray:
        """WIDTH x 256 x FILTERS: what a byte at a filter position adds to each filter."""
        return np.stack([self.emb @ self.conv[j * EMBED : (j + 1) * EMBED] for j in range(WIDTH)])


def _padded(text: bytes) -> np.ndarray:
    """Bytes with zeros up to whole half chunks, at least two, and a filter's width more."""
    half = HALF * STRIDE
    n = max(2, -(-len(text) // half))
    out = np.zeros(n * half + WIDTH, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def _filtered(data: np.ndarray, tables: np.ndarray, first: int, halves: int) -> np.ndarray:
    """Filter outputs, halves x HALF x FILTERS, from the given half chunk on."""
    a = first * HALF * STRIDE
    n = halves * HALF
    acc = np.take(tables[0], data[a : a + n * STRIDE : STRIDE], axis=0)
    for j in range(1, WIDTH):
        acc += np.take(tables[j], data[a + j : a + j + n * STRIDE : STRIDE], axis=0)
    return acc.reshape(halves, HALF, -1)


def scored(texts: list[str | None], net: Network, tables: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        data = _padded((t or "").encode("utf-8", "surrogatepass"))
        halves = (len(data) - WIDTH) // (HALF * STRIDE)
        top = np.concatenate([_filtered(data, tables, a, min(BLOCK, halves - a)).max(axis=1) for a in range(0, halves, BLOCK)])
        pooled = np.maximum(np.maximum(top[1:], top[:-1]) + net.conv_b, 0)
        h = np.maximum(pooled @ net.hid + net.hid_b, 0)
        z = float(np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ net.out + net.out_b[0])
        out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, batch: int = 16, rate: float = 4e-3, seed: int = 4) -> Network:
    net, g = Network.fresh(seed), np.random.default_rng(seed)
    epochs = epochs or int(np.clip(VISITS // max(1, len(texts)), 6, 40))
    good = float(labels.mean())
    weight = np.where(labels == 1, 2 * LEAN / (1 + LEAN) / max(2 * good, 1e-9), 2 / (1 + LEAN) / max(2 * (1 - good), 1e-9))
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    step = 0
    steps = max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = g.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads = [np.zeros_like(a) for a in net.arrays()]
            tables = net.tables()
            for i in rows:
                _backward(net, tables, _padded(texts[i]), float(labels[i]), float(weight[i]) / len(rows), grads)
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.95 * step / steps)
            for a, d, (m, v) in zip(net.arrays(), grads, moments):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                a -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + lr * 1e-3 * a).astype(np.float32)
    return net


def _backward(net: Network, tables: np.ndarray, data: np.ndarray, label: float, weight: float, grads: list[np.ndarray]) -> None:
    """Adds the gradients of a text's weighted logistic loss to grads."""
    halves = (len(data) - WIDTH) // (HALF * STRIDE)
    best, top = [], []
    for a in range(0, halves, BLOCK):
        f = _filtered(data, tables, a, min(BLOCK, halves - a))
        best.append(f.argmax(axis=1))
        top.append(np.take_along_axis(f, best[-1][:, None], 1)[:, 0])
    best, top = np.concatenate(best), np.concatenate(top)
    where = best + np.arange(halves)[:, None] * HALF  # filter position of each half chunk's maximum
    later = top[1:] > top[:-1]
    raw = np.where(later, top[1:], top[:-1]) + net.conv_b
    where = np.where(later, where[1:], where[:-1])
    pooled = np.maximum(raw, 0)
    pre = pooled @ net.hid + net.hid_b
    h = np.maximum(pre, 0)
    c, units = len(h), np.arange(HIDDEN)
    peak = h.argmax(axis=0)
    doc = np.concatenate([h[peak, units], h.mean(axis=0)])
    z = float(doc @ net.out + net.out_b[0])
    dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
    grads[5] += dz * doc
    grads[6] += dz
    dh = np.repeat((dz * net.out[HIDDEN:] / c)[None], c, 0)
    dh[peak, units] += dz * net.out[:HIDDEN]
    dh *= pre > 0
    grads[3] += pooled.T @ dh
    grads[4] += dh.sum(axis=0)
    dp = (dh @ net.hid.T) * (raw > 0)
    grads[2] += dp.sum(axis=0)
    # only the maxima pass gradients on: WIDTH bytes for each chunk and filter
    for a in range(0, c, BLOCK):
        d = dp[a : a + BLOCK]
        seen = data[where[a : a + BLOCK, :, None] * STRIDE + np.arange(WIDTH)]  # bytes under the filters
        grads[1] += np.einsum("cfk,cf->kf", net.emb[seen].reshape(len(d), FILTERS, -1), d)
        back = np.einsum("kf,cf->cfk", net.conv, d).reshape(len(d), FILTERS, WIDTH, EMBED)
        cells = seen[..., None].astype(np.int64) * EMBED + np.arange(EMBED)
        grads[0] += np.bincount(cells.ravel(), back.ravel(), 256 * EMBED).reshape(256, EMBED).astype(np.float32)


def fold(key: Column, folds: int = 4) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Network | None:
    """The network fitted on a bounded sample of labelled rows outside the held-out fold; None without both classes."""
    steps = Steps(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # the classes separately, so that the rarer one is not lost; max_train ids at most are broadcast
    half = max_train // 2
    order = [F.xxhash64(F.lit(4), "doc_id"), F.col("doc_id")]
    chosen = steps.put(known.where("quality = 0").orderBy(*order).limit(half).union(known.where("quality = 1").orderBy(*order).limit(half)), "chosen")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("hash")).join(F.broadcast(chosen), "doc_id")
    # max_train ids at most, so one window over them is bounded
    sized = sized.groupBy("doc_id", "quality").agg(F.min(F.struct("hash", "size")).alias("t"))
    total = F.sum("t.size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sample = steps.put(sized.select("doc_id", "quality", "t.hash", total.alias("total")).where(F.col("total") <= max_bytes), "sample")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(sample), ["doc_id", "hash"])
    rows = rows.select("doc_id", "quality", "text").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    steps.drop(chosen, sample)
    good = rows["quality"].to_numpy().astype(np.float32)
    if len(set(good)) < 2:
        return None
    return fit([t.encode("utf-8", "surrogatepass") for t in rows["text"].to_pylist()], good)


def _with_scores(docs: DataFrame, net: Network | None, threshold: float) -> DataFrame:
    """row (a struct of docs' columns), _score and _predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for b in batches:
            texts = b.column(1).to_pylist()
            s = scored(texts, net, tables) if net else np.full(len(texts), 0.5)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "_score", "_predicted"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text").mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """docs with _score and _predicted."""
    prepare(docs.sparkSession)
    rows = _with_scores(docs, train(docs, labels, folds, held, max_train), threshold)
    mine = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_score", "_predicted")]
    return rows.select(*mine, "_score", "_predicted")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those the classifier rejects; all of docs if there was nothing to learn from."""
    prepare(docs.sparkSession)
    net = train(docs, labels, folds, held, max_train)
    return _with_scores(docs, net, threshold).where("_predicted = 1").select("row.*") if net else docs

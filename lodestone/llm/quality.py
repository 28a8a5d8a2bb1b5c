"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks (neighbours share a filter's width, so no window is lost).
Filters over byte windows give one value for each place; each chunk keeps every filter's maximum; the mean over chunks,
weighted by their bytes, goes through a logistic layer into one probability. Training runs on the driver over a bounded
number of labelled documents, each read whole; scoring covers every byte of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

#: Places in a chunk, width of a filter, filters.
CHUNK, WIDTH, FILTERS = 512, 5, 24
#: Labelled documents to learn from, at most; documents in a step of learning; chunks that are looked at together.
SAMPLE_DOCS, EPOCHS, SEED, BATCH, TOGETHER = 4000, 8, 9, 32, 64


@dataclass
class Network:
    """table: of each offset in the window, each byte's share in each filter; bias, weight, offset: of filters and output."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float


def chunk_bytes(raw: bytes) -> list[bytes]:
    """Chunks that cover raw: CHUNK places each, and the bytes that windows at the last places need."""
    return [raw[a : a + CHUNK + WIDTH - 1] for a in range(0, max(1, len(raw)), CHUNK)]


def _matrix(chunks: list[bytes]) -> np.ndarray:
    size = CHUNK + WIDTH - 1
    return np.frombuffer(b"".join(c.ljust(size, b"\0") for c in chunks), np.uint8).reshape(-1, size)


def _places(chunks: list[bytes]) -> np.ndarray:
    return np.array([min(CHUNK, len(c)) for c in chunks])


def _convolve(net: Network, x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Filter values at each place; places beyond a text's end can't win."""
    z = net.table[0][x[:, :CHUNK]]
    for k in range(1, WIDTH):
        z += net.table[k][x[:, k : k + CHUNK]]
    if places.min() < CHUNK:
        z[np.arange(CHUNK)[None, :] >= places[:, None]] = -1e9
    return z


def pooled(net: Network, chunks: list[bytes], step: int = 16) -> np.ndarray:
    """Each chunk's maxima after the rectifier."""
    out = np.zeros((len(chunks), net.table.shape[2]), np.float32)
    for a in range(0, len(chunks), step):
        some = chunks[a : a + step]
        out[a : a + step] = np.maximum(_convolve(net, _matrix(some), _places(some)).max(axis=1) + net.bias, 0)
    return out


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """A probability for each text: the chunks' features averaged by their places (empty: no feature)."""
    chunks = [chunk_bytes(t) for t in texts]
    flat = [c for cs in chunks for c in cs]
    if not flat:
        return np.zeros(0)
    weight = _places(flat).astype(np.float64)
    owner = np.repeat(np.arange(len(texts)), [len(cs) for cs in chunks])
    logit = pooled(net, flat).astype(np.float64) @ net.weight
    total = np.bincount(owner, weight, len(texts))
    mean = np.bincount(owner, weight * logit, len(texts)) / np.maximum(total, 1)
    return _squash(np.where(total > 0, mean, 0.0) + net.offset)


def _strongest(net: Network, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk and filter: the value and the place of the maximum. A few chunks at a time, however long a text is."""
    best, at = np.zeros((len(x), FILTERS), np.float32), np.zeros((len(x), FILTERS), np.int64)
    for a in range(0, len(x), TOGETHER):
        z = _convolve(net, x[a : a + TOGETHER], places[a : a + TOGETHER])
        at[a : a + TOGETHER] = z.argmax(axis=1)
        best[a : a + TOGETHER] = np.take_along_axis(z, at[a : a + TOGETHER, None, :], 1)[:, 0, :]
    return best + net.bias, at


def train(docs: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learn from (text, label) pairs by Adam on the logistic loss. The maximum's window alone gets a gradient."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(0, 0.25, (WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS), 0.0)
    state = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (net.table, net.bias, net.weight, np.zeros(1))]
    steps = 0

    def adam(i: int, grad: np.ndarray, rate: float) -> np.ndarray:
        m, v = state[i]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        return rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)

    labels = np.array([y for _, y in docs], np.float64)
    if len(docs) == 0 or labels.min() == labels.max():
        net.weight[:] = 0
        net.offset = 3.0 if len(docs) == 0 or labels.max() == 1 else -3.0
        return net
    net.offset = float(np.log(labels.mean() / (1 - labels.mean())))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            chunks = [chunk_bytes(docs[i][0]) for i in batch]
            flat = [c for cs in chunks for c in cs]
            places = _places(flat)
            x = _matrix(flat)
            best, at = _strongest(net, x, places)
            feature = np.maximum(best, 0)
            owner = np.repeat(np.arange(len(batch)), [len(cs) for cs in chunks])
            share = places / np.maximum(np.bincount(owner, places, len(batch)), 1)[owner]
            mean = np.zeros((len(batch), FILTERS))
            np.add.at(mean, owner, share[:, None] * feature)
            error = (_squash(mean @ net.weight + net.offset) - labels[batch]) / len(batch)
            steps += 1
            back = (error[owner] * share)[:, None] * net.weight[None, :] * ((best > 0) & (places > 0)[:, None])
            grad = np.zeros(net.table.shape)
            rows = np.arange(len(flat))[:, None]
            for k in range(WIDTH):
                np.add.at(grad[k], (x[rows, at + k], np.arange(FILTERS)[None, :]), back)
            net.table -= adam(0, grad, rate).astype(np.float32)
            net.bias -= adam(1, back.sum(axis=0), rate).astype(np.float32)
            net.weight -= adam(2, mean.T @ error + 1e-4 * net.weight, rate)
            net.offset -= float(adam(3, np.array([error.sum()]), rate)[0])
    return net


def sample_of(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> list[tuple[bytes, int]]:
    """Texts and labels of at most SAMPLE_DOCS training documents, chosen by a hash of the id. An id with labels of both kinds
    teaches nothing; of an id with several texts the first in text order teaches; the texts are read whole."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(in_training(F.col(id_col)))
    agreed = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").drop("other")
    chosen = agreed.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).collect()
    return [(r.text.encode(), int(r.label)) for r in sorted(found, key=lambda r: r.doc_id)]


def in_training(ident):
    """Whether a document may teach: its id's crc32 isn't 2 modulo 4."""
    return F.crc32(ident.cast("string").cast("binary")) % 4 != 2


def train_on(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    return train(sample_of(docs, labels, label_col, id_col, text_col))


def with_score(docs: DataFrame, net: Network, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs and each row's score, as the last column `name`, which takes the place of one of that name.

    All other columns pass through unchanged; null texts are scored as empty ones, repeated rows alike; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession, 500)
    schema = docs.drop(name).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(net, texts), pa.float64())], names=[*batch.schema.names, name])

    return docs.drop(name).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null texts are scored as empty ones; null ids aren't held out and teach nothing, nor do ids whose labels disagree; repeated rows score alike; without
    labels of both kinds the score is a constant; an empty table gives no rows; only id and text are read.
    """
    net = train_on(docs, labels, id_col=id_col, text_col=text_col)
    scored = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net)
    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

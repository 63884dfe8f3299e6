"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded as `FEATURES` numbers (shares of character
classes, lengths, repeats), standardised and embedded. Gated attention, softmax over the document's passages of
w . (tanh(V h) * sigmoid(U h)), is learned from document labels only; the weighted sum of the embeddings is what the
document's score, a probability, is computed from. A few bad passages can so decide on a long document.

Training: labelled documents in the order of their ids' digests, at most `SAMPLE` of them and as many as have
`SAMPLE_PASSAGES` passages together, each with all its passages (one that has more alone is no part of the sample);
these two parameters bound what reaches the driver, where a network of a few thousand weights is fitted in numpy. Scoring encodes every passage of every text in one pass,
without a shuffle. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null, empty or blank text is a bag of one passage without words; a doc_id with several labels
counts by their mean; with no labels of one of the two kinds every score is the labels' mean, or 0.5 without any;
repeated rows score alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import free_name, table, word_count
from .textbytes import CLASS_OF, CLASSES, DIGIT, LINE, MARK, SKIP, SPACE, UPPER, WIDE, utf8

PASSAGE = 128
SAMPLE = 6000
SAMPLE_PASSAGES = 40_000
THRESHOLD = 0.3
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 60, 128, 0.01, 1e-4, 7
CHUNK = 2 << 20
MARKS = b"|!*.,\"=-"
FEATURES = CLASSES + len(MARKS) + 4 + 3  # character classes, marks, what words show, lengths


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each passage (float32, a row each), and the document each belongs to.

    All texts of a batch are encoded at once: white space gives words, words give passages, and the counts of bytes,
    characters and words of a passage are sums over its part of the batch.
    """
    docs = len(at) - 1
    if not docs:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    cls = CLASS_OF[data]
    white = (cls == SPACE) | (cls == LINE)
    first = ~white
    first[1:] &= white[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    first[inner] = ~white[inner]
    start = np.flatnonzero(first)  # first bytes of words
    doc_of_word = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(doc_of_word, minlength=docs)
    word_at = np.append(0, np.cumsum(n_words))
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    first_passage = np.append(0, np.cumsum(per_doc))
    n = int(first_passage[-1])
    passage_of_word = first_passage[doc_of_word] + (np.arange(len(start)) - word_at[doc_of_word]) // PASSAGE
    doc = np.repeat(np.arange(docs), per_doc)
    # Bytes belong to the passage of the last word that has started; what comes before the first word, to that.
    begin = at[doc].copy()
    opens = np.flatnonzero(np.append(True, passage_of_word[1:] != passage_of_word[:-1])) if len(start) else np.zeros(0, np.int64)
    later = opens[passage_of_word[opens] > first_passage[doc_of_word[opens]]] if len(start) else opens
    begin[passage_of_word[later]] = start[later]
    size = np.diff(np.append(begin, len(data)))
    passage = np.repeat(np.arange(n), size)

    real = cls != SKIP
    counts = np.bincount(passage[real] * CLASSES + cls[real], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    chars = np.maximum(counts.sum(1), 1)
    shares = [counts / chars[:, None]]
    mark = np.full(256, 255, np.uint8)
    mark[np.frombuffer(MARKS, np.uint8)] = np.arange(len(MARKS))
    kind = mark[data]
    seen = kind != 255
    marks = np.bincount(passage[seen] * len(MARKS) + kind[seen], minlength=n * len(MARKS)).reshape(n, -1)
    shares.append(marks / chars[:, None])
    # Words: a sum of mixed bytes by place stands for the word's text.
    words = np.maximum(np.bincount(passage_of_word, minlength=n), 1).astype(np.float64)
    if len(start):
        place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
        mixed = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed[white] = 0
        code = np.add.reduceat(mixed, start) % np.uint64(1 << 40)
        length = np.add.reduceat((real & ~white).astype(np.int64), start)
        pair = np.unique(passage_of_word.astype(np.uint64) << np.uint64(40) | code)
        kinds = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n)
        again = np.zeros(len(start), bool)
        again[1:] = (code[1:] == code[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
        upper = np.add.reduceat(cls == UPPER, start) * 2 > length
        per = [kinds, np.bincount(passage_of_word, again, n), np.bincount(passage_of_word, upper, n), np.bincount(passage_of_word, length == 1, n)]
        mean = np.bincount(passage_of_word, length, n) / words
        spread = np.sqrt(np.maximum(np.bincount(passage_of_word, length.astype(np.float64) ** 2, n) / words - mean**2, 0))
    else:
        per, mean, spread = [np.zeros(n)] * 4, np.zeros(n), np.zeros(n)
    shares.append(np.stack([p / words for p in per], 1))
    rest = np.stack([mean / 10, spread / 10], 1)
    out = np.concatenate([*shares, rest], 1)
    out[:, [DIGIT, LINE, MARK, WIDE]] = np.sqrt(out[:, [DIGIT, LINE, MARK, WIDE]])  # rare classes
    full = np.log1p(np.bincount(passage_of_word, minlength=n)) / np.log1p(PASSAGE)
    return np.concatenate([out, full[:, None]], 1).astype(np.float32), doc


def encoded(data: np.ndarray, at: np.ndarray, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """passages(); one text of more than `most` bytes is encoded in pieces that begin with a passage's first word."""
    if len(at) != 2 or len(data) <= most:
        return passages(data, at)
    cls = CLASS_OF[data]
    white = (cls == SPACE) | (cls == LINE)
    first = ~white
    first[1:] &= white[:-1]
    words = np.flatnonzero(first)
    step = max(1, most // 8 // PASSAGE) * PASSAGE
    cuts = [0, *words[step::step].tolist(), len(data)]
    parts = [passages(data[a:b], np.array([0, b - a], np.int64))[0] for a, b in zip(cuts, cuts[1:], strict=False)]
    x = np.concatenate(parts)
    return x, np.zeros(len(x), np.int64)


@dataclass
class Attention:
    """The fitted network; see `weights` for its shapes."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def embed(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ self.w["E"] + self.w["e"])

    def score(self, x: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """The probability of label 1 of each document; every document has a passage."""
        if self.constant is not None:
            return np.full(docs, self.constant)
        h = self.embed(x)
        a = (np.tanh(h @ self.w["V"]) * _sigmoid(h @ self.w["U"])) @ self.w["a"]
        first = np.searchsorted(doc, np.arange(docs))
        a = np.exp(a - np.maximum.reduceat(a, first)[doc]) if docs else a
        a = a / np.add.reduceat(a, first)[doc] if docs else a
        z = np.add.reduceat(h * a[:, None], first) if docs else np.zeros((0, HIDDEN))
        return _sigmoid(z @ self.w["c"] + self.w["b"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def weights(features: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(SEED)

    def of(*shape: int) -> np.ndarray:
        return g.normal(0, 1 / np.sqrt(shape[0]), shape)

    return {"E": of(features, HIDDEN), "e": np.zeros(HIDDEN), "V": of(HIDDEN, ATTENTION), "U": of(HIDDEN, ATTENTION), "a": of(ATTENTION), "c": of(HIDDEN), "b": np.zeros(1)}


def gradient(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross entropy of bags and its gradient; x holds the bags' standardised passages one after the other,
    first where each bag begins."""
    size = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ w["E"] + w["e"])
    t, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = (t * u) @ w["a"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), size))
    a /= np.repeat(np.add.reduceat(a, first), size)
    z = np.add.reduceat(a[:, None] * h, first)
    p = _sigmoid(z @ w["c"] + w["b"])
    loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    d = (p - y) / len(y)
    dz = np.repeat(d, size)[:, None] * w["c"]
    da = (dz * h).sum(1)
    dl = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
    dt, du = dl[:, None] * w["a"] * u * (1 - t**2), dl[:, None] * w["a"] * t * u * (1 - u)
    dh = (a[:, None] * dz + dt @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    grad = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "a": (dl[:, None] * t * u).sum(0), "c": z.T @ d, "b": d.sum(keepdims=True)}
    return loss, grad


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Attention:
    """Adam on the cross entropy of the documents' scores."""
    features = bags[0].shape[1] if bags else FEATURES
    if not len(labels) or labels.min() == labels.max():
        return Attention(np.zeros(features), np.ones(features), weights(features), float(labels.mean()) if len(labels) else 0.5)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    net = Attention(mean, scale, weights(features))
    w = net.w
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    g, step = np.random.default_rng(SEED), 0
    for _ in range(EPOCHS):
        order = g.permutation(len(bags))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            own = [bags[k] for k in pick]
            x = np.clip((np.concatenate(own) - mean) / scale, -8, 8)
            _, grad = gradient(w, x, np.cumsum([0, *map(len, own)])[:-1], labels[pick].astype(np.float64))
            step += 1
            for k, dk in grad.items():
                dk = dk + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * dk
                v[k] = 0.999 * v[k] + 0.001 * dk**2
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK bytes of text: first and last row, bytes, offsets."""
    data, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + CHUNK, "right")) - 1)
        yield start, end, data[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> Attention:
    """Fit on labelled rows that are not held out: see the module for the bounds `sample` and `most`."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType  # ids may be of any type with an order; those of labels are read as such
    own = labels.withColumn("doc_id", F.col("doc_id").try_cast(kind)).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    own = own.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)  # the bound of this module

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
            rows: list[list] = [[], [], []]
            for start, _, data, at in _parts(b, "text"):
                x, doc = encoded(data, at)
                for k in range(len(at) - 1):
                    own_rows = x[np.searchsorted(doc, k) : np.searchsorted(doc, k + 1)]
                    rows[0].append(ids[start + k])
                    rows[1].append(label[start + k])
                    rows[2].append(own_rows.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field("doc_id").type), pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.binary())], ["doc_id", "label", "bag"])

    picked = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most `sample` narrow rows
    sizes = picked.groupBy("doc_id", "label").agg(F.max(F.greatest(F.ceil(word_count(F.col("text")) / PASSAGE), F.lit(1))).alias("n")).filter(F.col("n") <= most)
    sizes = sizes.withColumn("sum", F.sum("n").over(Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")))  # `sample` rows
    picked = picked.join(F.broadcast(sizes.filter(F.col("sum") <= most).select("doc_id")), "doc_id")
    got = picked.select("doc_id", "label", "text").mapInArrow(encode, T.StructType([T.StructField("doc_id", kind), T.StructField("label", T.DoubleType()), T.StructField("bag", T.BinaryType())]))
    # Several rows of one doc_id count once, so the bound holds for what is collected as well.
    got = got.groupBy("doc_id", "label").agg(F.min("bag").alias("bag")).orderBy("doc_id").toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got.column("bag").to_pylist()]
    return fit(bags, (got.column("label").to_numpy() >= 0.5).astype(int))


def scored(docs: DataFrame, net: Attention, name: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with a column `name`, the score; all other columns stay, the text only with keep_text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower() and (keep_text or f.name != "text")]
    names = [f.name for f in kept]
    kinds = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0)]
            for start, end, data, at in _parts(b, "text"):
                x, doc = encoded(data, at)
                out.append(sent.value.score(x.astype(np.float64), doc, end - start))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(np.round(np.concatenate(out), 9))], [*names, name])

    return docs.mapInArrow(score, kinds)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that the classifier does not reject."""
    name = free_name(docs, "score")
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= threshold).select(*[f"`{c}`" for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters, of digits or of other visible bytes; each has a slot by the
hash of its lower-cased bytes, and marks for its shape (capitals, repetition of the
token before it) are tokens of their own. A slot's vector is its sparse random index
vector plus the normalised sum of the index vectors of its neighbours in the training
sample. A document is the mean of its tokens' vectors (and of PRIOR zeros). A network of one hidden layer
learns labels from that, rare ones with more weight, whose effect on the odds is taken back
afterwards; a temperature fitted on a fifth of the sample calibrates its probabilities.

The fit takes at most SAMPLE distinct labelled documents of at most LONGEST bytes (documented
bounds), those of the least hashes; scoring reads every whole text. Neighbour sums are made on
the executors, in PARTS pieces of SLOTS x WIDTH numbers; the pooled sample (SAMPLE x
WIDTH numbers) is all that training holds on the driver.

Null and empty texts pool to zeros and get the network's score of that. Without labels
every score is 0.5. An empty table gives no rows. Rows with a null label are not learned from; a null doc_id is never
held out. Repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm import kit

SLOTS = 1 << 14
WIDTH = 64
PARTS = 4
SAMPLE = 6000
LONGEST = 65_536
HIDDEN = 32
#: Tokens without a direction that are added to each document: short texts stay near zero.
PRIOR = 10
#: Marks of shape, after the slots of words.
ALL_CAPS, AGAIN, MARKS = 0, 1, 2

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letters, 2 digits, 3 other
_KIND[list(kit.SPACES)] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def index_vectors() -> np.ndarray:
    """Four +1 or -1 in each slot's vector, at random places; from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((SLOTS + MARKS, WIDTH), np.float32)
    for _ in range(4):
        out[np.arange(len(out)), rng.integers(0, WIDTH, len(out))] = rng.choice(np.array([-1, 1], np.float32), len(out))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens, marks included, and each one's document."""
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    doc = np.searchsorted(offsets, starts, "right") - 1
    h = kit.span_hashes(kit.LOWER[data], starts, ends)
    slot = (h % np.uint64(SLOTS)).astype(np.int64)
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    caps = (kind[starts] == 1) & (ends - starts > 1) & (ups[ends] - ups[starts] == ends - starts)
    again = np.zeros(len(starts), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    marked = [(caps, SLOTS + ALL_CAPS), (again, SLOTS + AGAIN)]
    return np.concatenate([slot, *(np.full(int(m.sum()), s) for m, s in marked)]), np.concatenate([doc, *(doc[m] for m, _ in marked)])


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of the documents: a sparse count matrix times the vectors."""
    n = len(offsets) - 1
    slot, doc = tokens(data, offsets)
    key, times = np.unique(doc * len(vectors) + slot, return_counts=True)
    doc, slot = key // len(vectors), key % len(vectors)
    out = np.zeros((n, vectors.shape[1]), np.float32)
    if len(key):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        sums = np.add.reduceat(vectors[slot] * times[:, None].astype(np.float32), first)
        out[doc[first]] = sums / (np.add.reduceat(times, first)[:, None] + PRIOR)
    return out


def neighbour_sums(rows: DataFrame) -> np.ndarray:
    """Summed index vectors of each slot's neighbours (two words to either side)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros_like(index)
        for b in batches:
            for _, _, data, offsets in kit.text_chunks(b.column(0), 1 << 19):
                slot, doc = tokens(data, offsets)
                words = slot < SLOTS
                slot, doc = slot[words], doc[words]
                for apart in (1, 2):
                    same = doc[apart:] == doc[:-apart]
                    a, z = slot[:-apart][same], slot[apart:][same]
                    pair, n = np.unique(np.concatenate([a * SLOTS + z, z * SLOTS + a]), return_counts=True)
                    to = pair // SLOTS
                    if len(pair):
                        first = np.flatnonzero(np.diff(to, prepend=-1))
                        total[to[first]] += np.add.reduceat(index[pair % SLOTS] * n[:, None].astype(np.float32), first)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.select("text").repartition(PARTS).mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(r["total"], np.float32).reshape(-1, WIDTH) for r in parts), np.zeros((SLOTS + MARKS, WIDTH), np.float32))


class Network:
    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60) -> None:
        rng = np.random.Generator(np.random.PCG64(11))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = self.prepared(x)
        aside = np.arange(len(x)) % 5 == 0
        fit_x, fit_y = x[~aside], y[~aside]
        weight = np.where(fit_y == 1, 0.5 / max(fit_y.mean(), 1e-3), 0.5 / max(1 - fit_y.mean(), 1e-3))
        weight = np.sqrt(weight)
        self.shift = float(np.log(weight[fit_y == 1].max(initial=0) / weight[fit_y == 0].max(initial=0))) if 0 < fit_y.mean() < 1 else 0.0
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(fit_x))
            for lo in range(0, len(order), 128):
                i = order[lo : lo + 128]
                h = np.tanh(fit_x[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - fit_y[i]) * weight[i] / len(i)
                back = d[:, None] * p[2] * (1 - h * h)
                grads = [fit_x[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        z, held = self.logits(x[aside]), y[aside]
        grid = np.exp(np.linspace(-np.log(8), np.log(16), 140))
        loss = [np.logaddexp(0, np.where(held == 1, -z, z) / s).mean() for s in grid] if len(held) else [0.0]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3] - self.shift

    def scores(self, pooled_x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.prepared(pooled_x)) / self.temperature, -30, 30)))


def fit(rows: DataFrame, label_col: str = "quality") -> tuple[np.ndarray, Network | None]:
    """Vectors and network of rows(text, label); rows are at most a bounded sample."""
    context = neighbour_sums(rows)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = (index_vectors() + context / np.maximum(norm, 1) * 2).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(0), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in pooled(data, offsets, vectors)], pa.binary()), b.column(1).slice(lo, hi - lo)], ["x", "y"])

    got = rows.select("text", F.col(label_col).cast("int").alias("y")).mapInArrow(run, "x binary, y int").collect()
    got.sort(key=lambda r: (r["x"], r["y"]))
    y = np.array([r["y"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return vectors, None
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got])
    mixed = np.random.Generator(np.random.PCG64(3)).permutation(len(y))
    return vectors, Network(x[mixed], y[mixed])


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None, *keep: str) -> DataFrame:
    """keep, score, predicted for docs(text, ...)."""
    own = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(len(keep)), 1 << 19):
                s = network.scores(pooled(data, offsets, vectors)) if network else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return own.mapInArrow(run, f"{kinds}, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """keep, score and predicted of all docs; learned from labelled docs whose crc32 remainder is not 1."""
    learn = labels.filter(F.col("quality").isNotNull() & F.coalesce(kit.remainder("doc_id", 3) != 1, F.lit(False))).select(F.col("doc_id").alias("_id"), "quality")
    picked = learn.groupBy("_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(2 * SAMPLE)
    texts = docs.filter(F.octet_length("text") <= LONGEST).select("doc_id", "text")
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(F.xxhash64("_id", "text").alias("h"), "text", "quality")
    most = found.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    rows = found.filter(F.col("h") <= F.lit(most)).groupBy("h").agg(F.first("text").alias("text"), F.max("quality").alias("quality"))
    return score(docs, *fit(kit.stored(rows.select("text", "quality"), "sample")), *keep)


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = F.coalesce(kit.remainder("doc_id", 3) == 1, F.lit(False))
    return classified(docs.select("doc_id", "text", out.alias("held_out")), labels, "doc_id", "held_out")

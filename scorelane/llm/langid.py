"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ORDER with the bytes that
followed them. The probability of a byte blends the orders with escape weights: at a
context seen t times with u different followers, p = (count + u * p_shorter) / (t + u),
down to a uniform 1/256. Statistics are frozen after training, so the code length of
each byte after its longest known context is a fixed number per language; these are
tabulated once and a text's exact code lengths are sums of table rows over its bytes.
The shortest code names the language.

The trees hold at most NODES contexts, those that make up the largest share of a language
of the sample, and fewer where there are more than FULL languages. Training takes about
SAMPLE distinct documents per language, fewer with more languages but 20 at least, and of
each at most LONGEST bytes (documented bounds of the fit; every language that occurs is
learned, and every document is scored over its whole text).

Null texts and texts without a letter are 'und' with score 0. Rows with a null language
are never learned from. Without training rows everything is 'und'.
Repeated rows get a row each, ties go to the first language by name, an empty table gives
no rows, and only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm import kit

ORDER = 4
NODES = 12_000
SAMPLE = 400
LONGEST = 16_384
#: Languages whose tables have NODES contexts; with more of them each table has fewer.
FULL = 8
#: Fixed value of the contract: a letter.
LETTER = regex.compile(r"\p{L}")
_LANGS = 16  # bits of a language number


class Trees:
    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, most: int = NODES) -> None:
        self.langs = sorted(texts)
        self.order = order
        streams = [[np.frombuffer(t, np.uint8) for t in texts[lang] if t] for lang in self.langs]
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *(s for x in streams for s in x)]))
        self.symbol = np.full(256, len(seen), np.uint8)
        self.symbol[seen] = np.arange(len(seen))
        width = len(seen) + 1  # the last symbol stands for each byte never seen
        counted = [self._followers(streams, k) for k in range(order + 1)]
        contexts = [np.unique(c[0], return_inverse=True) for c in counted]
        times = [np.bincount(at, c[2], len(keys)) for (keys, at), c in zip(contexts, counted, strict=True)]
        of_lang = np.maximum(np.array([sum(map(len, x)) for x in streams], float), 1)
        worth = []  # a context's largest share of a language's bytes, so that rare languages keep theirs
        for (keys, at), c in zip(contexts, counted, strict=True):
            pair, n = np.unique(at * len(self.langs) + (c[1] & ((1 << _LANGS) - 1)), return_inverse=True)
            share = np.bincount(n, c[2], len(pair)) / of_lang[pair % max(len(self.langs), 1)]
            top = np.zeros(len(keys))
            np.maximum.at(top, pair // max(len(self.langs), 1), share)
            worth.append(np.where(times[len(worth)] >= 2, top, 0.0))
        most = most * FULL // max(FULL, len(self.langs))
        ranked = np.sort(np.concatenate(worth))[::-1]
        least = max(float(ranked[most]) if len(ranked) > most else 0.0, 1e-300)
        uniform = np.full((1, width, len(self.langs)), 1 / 256)
        root = self._dense(counted[0], np.zeros(len(counted[0][0]), np.int64), 1, width)
        probability = [self._blend(root, uniform)]
        child = [np.zeros((1, width), np.int64)]
        shorter = {0: 0}  # node of each context of the order before
        base = 1
        for k in range(1, order + 1):
            keys, at = contexts[k]
            keep = np.array([i for i in np.flatnonzero(worth[k] > least) if int(keys[i]) >> 8 in shorter], np.int64)
            parent = np.array([shorter[int(keys[i]) >> 8] for i in keep], np.int64)
            place = np.full(len(keys), -1, np.int64)
            place[keep] = np.arange(len(keep))
            used = place[at] >= 0
            counts = self._dense(tuple(x[used] for x in counted[k]), place[at[used]], len(keep), width)
            probability.append(self._blend(counts, np.concatenate(probability)[parent]))
            child.append(np.zeros((len(keep), width), np.int64))
            whole = np.concatenate(child)
            whole[parent, keys[keep] & 255] = base + np.arange(len(keep))
            child = [whole]
            shorter = {int(keys[i]): base + j for j, i in enumerate(keep)}
            base += len(keep)
        self.child = child[0].astype(np.int16 if base < 32_000 else np.int32)
        self.bits = -np.log2(np.concatenate(probability)).astype(np.float32)

    def _followers(self, streams: list[list[np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
        """Contexts of k bytes (nearest byte highest), symbol and language, times."""
        pairs = [np.zeros(0, np.int64)]
        for j, group in enumerate(streams):
            for s in group:
                if len(s) > k:
                    x = self.symbol[s].astype(np.int64)
                    key = np.zeros(len(x) - k, np.int64)
                    for back in range(1, k + 1):
                        key = key * 256 + x[k - back : len(x) - back]
                    pairs.append((key << 8 + _LANGS) | (x[k:] << _LANGS) | j)
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        return pair >> 8 + _LANGS, pair & ((1 << 8 + _LANGS) - 1), n

    def _dense(self, counted: tuple[np.ndarray, ...], at: np.ndarray, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, width, len(self.langs)))
        np.add.at(out, (at, counted[1] >> _LANGS, counted[1] & ((1 << _LANGS) - 1)), counted[2])
        return out

    @staticmethod
    def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """The unseen symbol's share is that of one such byte."""
        t, u = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        return np.where(t > 0, (counts + u * shorter) / np.maximum(t + u, 1), shorter)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        n = len(data)
        x = self.symbol[data].astype(np.intp)
        begins = np.repeat(offsets[:-1], np.diff(offsets))
        depth = np.arange(n) - begins
        node = np.zeros(n, self.child.dtype)
        live = np.arange(n)
        flat, width = self.child.ravel(), self.child.shape[1]
        for k in range(1, self.order + 1):
            live = live[depth[live] >= k]
            nxt = flat[node[live].astype(np.intp) * width + x[live - k]]
            live, nxt = live[nxt > 0], nxt[nxt > 0]
            node[live] = nxt
        cost = self.bits.reshape(-1, len(self.langs))[node.astype(np.intp) * width + x]
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(cost, 0, dtype=np.float64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Trees of about `sample` documents per language, picked by a hash of id and text."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.col(id_col).alias("i"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Trees({})
    sample = max(20, min(sample, sample * FULL // len(counts)))
    at = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 40)) / float(1 << 40)
    share: Column = F.create_map(*[x for l, n in counts.items() for x in (F.lit(l), F.lit(min(1.0, sample / n)))])
    picked: dict[str, list[bytes]] = {l: [] for l in counts}
    chosen = rows.withColumn("at", at).filter(F.col("at") < share[F.col("l")]).groupBy("l", "at").agg(F.first(F.substring("t", 1, LONGEST)).alias("t"))
    for r in chosen.orderBy("at").limit(2 * sample * len(counts)).collect():
        picked[r["l"]].append(r["t"].encode()[:LONGEST])
    return Trees({l: x for l, x in picked.items() if x})


def identify(docs: DataFrame, trees: Trees, *keep: str, text_col: str = "text") -> DataFrame:
    """keep, lang_pred, score (the posterior of equal priors, of the code lengths)."""
    own = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = own.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*trees.langs, "und"], object)
        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(len(keep)), 1 << 20):
                letters = np.array([bool(x) and bool(LETTER.search(x)) for x in b.column(len(keep)).slice(lo, hi - lo).to_pylist()], bool)
                best, score = np.full(hi - lo, len(trees.langs)), np.zeros(hi - lo)
                if trees.langs:
                    bits = trees.lengths(data, offsets)
                    win = bits.argmin(1)
                    odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    best, score = np.where(letters, win, best), np.where(letters, 1 / odds, 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "lang_pred string", "score double"]))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents whose crc32 remainder is not 2."""
    out = F.coalesce(kit.remainder("doc_id", 4) == 2, F.lit(False))
    marked = docs.select("doc_id", "text", "lang", out.alias("held_out"))
    return identify(marked, train(marked.filter(~F.col("held_out"))), "doc_id", "held_out")

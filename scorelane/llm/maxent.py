"""Language-model scores: unigram base and a hashed maximum-entropy model.

Base counts are exact over all documents. Tasks send the counts of their words, summed
before they are sent, to blocks of the hash range; what comes of it are the totals and the
head: words that make up at least a 2^-HEAD of all tokens, so at most 2^HEAD of them,
which every executor gets. The logarithms of head words are summed where the documents
lie. Of all other words each document sends its hashes and their times to blocks, which
return sums per document; no key of theirs holds more than a 2^-HEAD of the tokens.

The model is a softmax factored by classes, P(word) = P(class | context) * P(word | class,
context). A word's class follows from its first and last byte; the end of a text is a
class. Inside a class the word's hash, five bits at a time, names a path of `depth` further
choices of 32, each a softmax of the same kind; words that share the whole path (a cell)
have their relative frequencies, (c + 1) / (N + V + 1) of the cell, which leaves each cell a
share for unseen words, so that all outcomes' probabilities add up to 1. The depth grows
with the logarithm of the corpus.

A choice's scores are sums of rows of a table of weights, one row for each hashed feature
of the words before: none, the previous word, and the skip over one word; each together
with the path so far. The table grows with the square root of the training
tokens, since every executor holds it. It is trained by distributed gradient updates: in a
pass over all training tokens every task takes Adagrad steps on its part and sends the rows
it changed; a row becomes its average over the tasks that used it, by use. Training ends
after a pass whose second half met a log likelihood better than that of its first half by
less than SETTLED of what the first pass met, or at PASSES: one pass over a large corpus, several over a small one.

Words are told apart by 64-bit hashes. Null and empty texts are one end token. Rows with a
null doc_id are learned from and not held out. Repeated rows are scored each. Without
training documents counts are zero. An empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm import kit

CLASSES = 32
END = CLASSES - 1
WAYS = 5  # bits of a choice inside a class
BUCKETS = 1 << 13  # the least number of rows of weights
BATCH = 1 << 14
RATE = 0.25
SETTLED = 0.03
PASSES = 20
TASK_BYTES = 256 << 20
SLICES = 16
POSTINGS = 2_000_000
#: Head words have at least a 2^-HEAD of all tokens.
HEAD = 15
#: Scores within this have exponentials that neither overflow nor vanish, so no maximum need be taken off.
SAFE = 60.0
#: Longer runs are summed one by one.
LONG = 64
#: Words whose counts a task holds before it sends them.
HELD = 1 << 20


def _classes() -> np.ndarray:
    pair = kit.mixed(np.arange(1 << 16, dtype=np.uint64))
    return (pair % np.uint64(CLASSES - 1)).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (its low five bits are the class), class and document of each word."""
    data = kit.LOWER[data]
    starts, ends, doc = kit.spans(data, offsets, kit.IS_WORD)
    cls = _classes()[data[starts].astype(np.int64) << 8 | data[ends - 1]]
    h = (kit.span_hashes(data, starts, ends) & ~np.uint64(CLASSES - 1)) | cls.astype(np.uint64)
    return h, cls, doc


def shape(tokens: int) -> tuple[int, int]:
    """Choices inside a class, and rows of weights, for so many training tokens."""
    return max(1, round(np.log2(max(tokens, 1) / 2**19) / WAYS)), max(BUCKETS, 16 * int(max(tokens, 1) ** 0.5))


def cells(h: np.ndarray, depth: int) -> np.ndarray:
    return h >> np.uint64(64 - WAYS * depth) << np.uint64(WAYS) | h & np.uint64(CLASSES - 1)


def stream(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of all tokens, ends included, their documents, and the first and second token before each."""
    n = np.bincount(doc, minlength=n_docs) + 1
    edges = np.concatenate([[0], np.cumsum(n)])
    out = np.full(edges[-1], END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    owner = np.repeat(np.arange(n_docs), n)
    depth = np.arange(len(out)) - edges[owner]
    context = []
    for back in (1, 2):
        before = np.full(len(out), END, np.uint64)  # nothing before the first token: as after an end
        before[back:] = out[:-back]
        before[depth < back] = END
        context.append(before)
    return out, owner, context


def feature_hashes(context: list[np.ndarray]) -> np.ndarray:
    """Hashes of the features of each context: the previous word, the skip over one."""
    one, two = context
    out = np.empty((len(one), 2), np.uint64)
    for k, own in enumerate((one, two)):
        out[:, k] = kit.mixed(own + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
    return out


def nodes(depth: int) -> int:
    """How many choices there are: of a class, and at each place of the paths inside."""
    return 1 + CLASSES * sum(1 << WAYS * k for k in range(depth))


def choices(h: np.ndarray, context: list[np.ndarray], depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of weights, outcome and token of each choice: classes of all tokens, then the choices inside the class.

    The first row is that of the choice itself, without a word before; these follow the
    buckets of hashed ones.
    """
    features, cls = feature_hashes(context), (h & np.uint64(CLASSES - 1)).astype(np.int64)
    inner = np.flatnonzero(cls != END)
    token, node, outcome = [np.arange(len(h))], [np.zeros(len(h), np.int64)], [cls]
    for k in range(1, depth + 1):
        top = (h[inner] >> np.uint64(64 - WAYS * k)).astype(np.int64)
        token.append(inner)
        node.append(nodes(k - 1) + (cls[inner] << WAYS * (k - 1)) + (top >> WAYS))
        outcome.append(top & (CLASSES - 1))
    token, node = np.concatenate(token), np.concatenate(node)
    raw = kit.mixed(features[token] ^ kit.mixed(node.astype(np.uint64))[:, None])
    rows = np.empty((len(token), features.shape[1] + 1), np.int64)
    rows[:, 0] = buckets + node
    rows[:, 1:] = (raw >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return rows, np.concatenate(outcome), token


def scores(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all outcomes and their sums of exponentials; rows: the rows of weights of each choice, or the only one."""
    rows = rows.reshape(len(rows), -1)
    z = np.take(weights, rows[:, 0], axis=0)
    more = np.empty_like(z)
    for k in rows.T[1:]:
        z += np.take(weights, k, axis=0, out=more, mode="clip")
    if z.size and max(z.max(), -z.min()) > SAFE:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=more)
    return z, more


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of the outcomes."""
    z, e = scores(weights, rows)
    z -= np.log(e @ np.ones(e.shape[1], e.dtype))[:, None]
    return z


def log_outcomes(weights: np.ndarray, rows: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """Log probability of one outcome of each choice."""
    z, e = scores(weights, rows)
    return z[np.arange(len(z)), outcome] - np.log(e @ np.ones(e.shape[1], e.dtype))


def run_sums(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs, and in it the sums of x[at] over runs of n places each.

    The longest runs come first: the k-th places of all runs that have them are added at once.
    Runs of more than LONG places are summed each for itself.
    """
    order = np.argsort(-n, kind="stable")
    start, n = (np.cumsum(n) - n)[order], n[order]
    many = int(np.searchsorted(-n, -LONG))
    out = np.take(x, at[start], axis=0)
    for i in range(many):
        own = np.take(x, at[start[i] : start[i] + n[i]], axis=0)
        out[i] = np.ones(n[i], x.dtype) @ own
    start, n, rest = start[many:], n[many:], out[many:]
    for k in range(1, int(n[0]) if len(n) else 0):
        some = int(np.searchsorted(-n, -k))
        rest[:some] += np.take(x, at[start[:some] + k], axis=0)
    return order, out


def step(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, outcome: np.ndarray, buckets: int) -> float:
    """One Adagrad step, in place; the log likelihood before it."""
    z, d = scores(weights, rows)
    here, total = np.arange(len(rows)), d @ np.ones(d.shape[1], d.dtype)
    before = float((z[here, outcome] - np.log(total)).sum())
    d *= (-1 / total)[:, None]
    d[here, outcome] += 1
    node = (rows[:, 0] - buckets).astype(np.uint16 if len(weights) - buckets < 1 << 16 else np.int64)
    flat = np.sort(rows[:, 1:].T.ravel() << 32 | np.tile(here, rows.shape[1] - 1))
    for row, at in ((rows[:, 0], np.argsort(node, kind="stable")), (None, None)):
        row, at = (row[at], at) if at is not None else (flat >> 32, flat & 0xFFFFFFFF)
        edges = np.flatnonzero(np.diff(row, prepend=-1))
        order, g = run_sums(d, at, np.diff(np.append(edges, len(row))))
        times, mine = np.diff(np.append(edges, len(row)))[order], row[edges][order]
        total = squares[mine] + np.einsum("ij,ij->i", g, g)
        squares[mine] = total
        g *= (RATE / (np.sqrt(total) + np.float32(1e-6)))[:, None]
        g += np.take(weights, mine, axis=0)
        weights[mine] = g
        used[mine] += times
    return before


def trained(train: DataFrame, depth: int, buckets: int) -> tuple[np.ndarray, list[float]]:
    """Weights learned from train(text), and the mean log likelihood of a token met in each pass."""
    context = train.sparkSession.sparkContext
    whole = buckets + nodes(depth)
    weights, squares = np.zeros((whole, CLASSES), np.float32), np.zeros(whole, np.float32)
    size = -(-whole // SLICES)
    kinds = {"rows": np.int64, "change": np.float32, "used": np.float32, "squares": np.float32}
    schema = "slice long, rows binary, change binary, used binary, squares binary"

    def packed(k: int, *arrays: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(arrays, kinds.values(), strict=True))], ["slice", *kinds])

    def added(t: pa.Table) -> pa.Table:
        k = t["slice"][0].as_py()
        if k < 0:
            seen = sum(np.frombuffer(x, np.float64) for x in t["rows"].to_pylist())
            return pa.table({"slice": [k], "rows": pa.array([seen.tobytes()], pa.binary()), **{x: pa.array([b""], pa.binary()) for x in list(kinds)[1:]}})
        n = min(size, whole - k * size)
        change, used, total = np.zeros((n, CLASSES), np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
        for i in range(len(t)):
            rows, c, u, q = (np.frombuffer(t[x][i].as_py(), kind) for x, kind in kinds.items())
            change[rows] += c.reshape(-1, CLASSES) * u[:, None]
            used[rows] += u
            total[rows] += q
        rows = np.flatnonzero(used)
        return pa.Table.from_batches([packed(k, rows, change[rows] / used[rows, None], used[rows], total[rows])])

    history: list[float] = []
    while len(history) < PASSES:
        sent = context.broadcast((weights, squares))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            w, q = (x.copy() for x in sent.value)
            used, met = np.zeros(whole, np.float32), []
            for b in batches:
                for lo, hi, data, offsets in kit.text_chunks(b.column(0)):
                    h, _, doc = words(data, offsets)
                    h, _, before = stream(h, doc, hi - lo)
                    size_of = min(BATCH, max(512, len(h) // 16))  # small corpora take more steps a pass
                    for at in range(0, len(h), size_of):
                        cut = slice(at, at + size_of)
                        rows, outcome, _ = choices(h[cut], [x[cut] for x in before], depth, buckets)
                        met.append((step(w, q, used, rows, outcome, buckets), len(h[cut])))
            half = len(met) // 2
            seen = np.array([np.sum(met[:half], 0) if half else (0, 0), np.sum(met[half:], 0) if met else (0, 0)], np.float64)
            first, squared = sent.value
            for k in range(-(-whole // size)):
                own = slice(k * size, (k + 1) * size)
                rows = np.flatnonzero(used[own])
                if len(rows):
                    at = rows + k * size
                    yield packed(k, rows, w[at] - first[at], used[at], q[at] - squared[at])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([seen.tobytes()], pa.binary()), *[pa.array([b""], pa.binary())] * 3], ["slice", *kinds])

        changed = kit.stored(train.mapInArrow(learn, schema).groupBy("slice").applyInArrow(added, schema), "changes")
        seen = np.zeros((2, 2))
        for r in changed.toLocalIterator():
            if r["slice"] < 0:
                seen = np.frombuffer(r["rows"], np.float64).reshape(2, 2)
                continue
            at = np.frombuffer(r["rows"], np.int64) + r["slice"] * size
            weights[at] += np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
            squares[at] += np.frombuffer(r["squares"], np.float32)
        kit.release(changed)
        sent.destroy()
        if not seen[1, 1]:
            break
        history.append(float(seen[:, 0].sum() / seen[:, 1].sum()))
        early, late = seen[:, 0] / np.maximum(seen[:, 1], 1)
        if seen[0, 1] and late - early < SETTLED * -history[0]:
            break
    return weights, history


class Counts:
    """Totals of the training documents, counts of the head words, and the totals of each cell."""

    def __init__(self, docs: DataFrame, blocks: int, depth: int, train: int) -> None:
        """docs(text, held_out); train: how many documents are learned from, each with one end token."""
        stored = kit.stored(word_counts(docs, blocks), "counts")
        every = stored.agg(F.sum("total")).first()[0] or 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for h, c, of_all in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                    h, c, of_all = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(of_all, np.int64)
                    cell, back = np.unique(cells(h, depth), return_inverse=True)
                    n, v = (np.bincount(back, x, len(cell)).astype(np.int64) for x in (c, c > 0))
                    some = of_all << HEAD >= every
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (cell, n, v, h[some], c[some])], ["cell", "n", "v", "h", "c"])

        found = stored.select("h", "c", "of_all").mapInArrow(run, "cell binary, n binary, v binary, h binary, c binary").collect()
        kit.release(stored)
        whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in found)])
        h = whole("h", np.uint64)
        order = np.argsort(h)
        self.head, self.count = h[order], whole("c", np.int64)[order]
        self.cell, back = np.unique(whole("cell", np.uint64), return_inverse=True)
        n, v = (np.bincount(back, whole(k, np.int64), len(self.cell)).astype(np.int64) for k in ("n", "v"))
        self.size, self.depth, self.train = n + v + 1, depth, train
        self.tokens, self.distinct = int(n.sum()) + train, int(v.sum()) + (train > 0)

    def logs(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of count + 1, and of the share in the cell, of words h with counts c; all cells of words are known."""
        log = np.log10(c + 1)
        return log, log - np.log10(self.size[np.searchsorted(self.cell, cells(h, self.depth))])

    def in_head(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head, and whether the word is there at all."""
        at = np.minimum(np.searchsorted(self.head, h), max(len(self.head) - 1, 0))
        return at, self.head[at] == h if len(self.head) else np.zeros(len(h), bool)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _runs(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending blocks and the edges of their runs."""
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    return block[edges[:-1]], edges


def word_counts(docs: DataFrame, blocks: int) -> DataFrame:
    """h, c, of_all (packed: words and their counts in training and in all documents) and total, by block of the hash range."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            h, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, *(np.bincount(back, np.concatenate([x[k] for x in held]), len(h)).astype(np.int64) for k in (1, 2))

        def sent(h: np.ndarray, c: np.ndarray, of_all: np.ndarray) -> pa.RecordBatch:
            at, edges = _runs(_block(h, blocks))
            cols = [[x[i:e].tobytes() for i, e in zip(edges[:-1], edges[1:], strict=True)] for x in (h, c, of_all)]
            return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x, pa.binary()) for x in cols)], ["block", "h", "c", "of_all"])

        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(0)):
                h, _, doc = words(data, offsets)
                out = b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                h, back, n = np.unique(h, return_inverse=True, return_counts=True)
                held.append((h, np.bincount(back, ~out[doc], len(h)).astype(np.int64), n))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged())

    def added(t: pa.Table) -> pa.Table:
        h, back = np.unique(np.frombuffer(b"".join(t["h"].to_pylist()), np.uint64), return_inverse=True)
        c, of_all = (np.bincount(back, np.frombuffer(b"".join(t[k].to_pylist()), np.int64), len(h)).astype(np.int64) for k in ("c", "of_all"))
        return pa.table({"total": [int(of_all.sum())], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("h", h), ("c", c), ("of_all", of_all))}})

    rows = docs.select("text", "held_out").mapInArrow(counts, "block long, h binary, c binary, of_all binary")
    return rows.groupBy("block").applyInArrow(added, "total long, h binary, c binary, of_all binary")


def tail_sums(docs: DataFrame, counts: Counts, blocks: int) -> DataFrame:
    """key, sums, known, shares of the words beyond the head of each key of docs(key, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(1), 1 << 20):
                h, _, doc = words(data, offsets)
                rare = ~sent.value.in_head(h)[1]
                h, doc = h[rare], doc[rare]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
                times = np.diff(np.append(new, len(h)))
                h, doc = h[new], doc[new]
                at, edges = _runs(_block(h, blocks))
                key = b.column(0).slice(lo, hi - lo).to_numpy()[doc]
                out = b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.uint8)[doc]
                cols = [[x[i:e].tobytes() for i, e in zip(edges[:-1], edges[1:], strict=True)] for x in (h, key, times.astype(np.uint32), out)]
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c, pa.binary()) for c in cols)], ["block", "h", "key", "times", "out"])

    def counted(t: pa.Table) -> pa.Table:
        h, key, times, out = (np.frombuffer(b"".join(t[k].to_pylist()), kind) for k, kind in (("h", np.uint64), ("key", np.int64), ("times", np.uint32), ("out", np.uint8)))
        values, back = np.unique(h, return_inverse=True)
        c = np.bincount(back, times * (out == 0), len(values)).astype(np.int64)
        keys, row = np.unique(key, return_inverse=True)
        sums = [np.bincount(row, times * x[back], len(keys)) for x in (*sent.value.logs(values, c), c > 0)]
        group = (kit.mixed(keys.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        at, edges = _runs(group[order])
        cut = [[x[order][i:e].tobytes() for i, e in zip(edges[:-1], edges[1:], strict=True)] for x in (keys, *sums)]
        return pa.table({"group": at, **{k: pa.array(x, pa.binary()) for k, x in zip(("keys", "sums", "shares", "known"), cut, strict=True)}})

    def summed(t: pa.Table) -> pa.Table:
        keys, sums, shares, known = (np.frombuffer(b"".join(t[k].to_pylist()), kind) for k, kind in (("keys", np.int64), ("sums", np.float64), ("shares", np.float64), ("known", np.float64)))
        ids, back = np.unique(keys, return_inverse=True)
        return pa.table({"key": ids, **{k: np.bincount(back, x, len(ids)) for k, x in (("sums", sums), ("shares", shares), ("known", known))}})

    rows = docs.select("key", "text", "held_out").mapInArrow(postings, "block long, h binary, key binary, times binary, out binary")
    partial = rows.groupBy("block").applyInArrow(counted, "group long, keys binary, sums binary, shares binary, known binary")
    return partial.groupBy("group").applyInArrow(summed, "key long, sums double, shares double, known double")


def head_and_model(docs: DataFrame, weights: np.ndarray, counts: Counts) -> DataFrame:
    """doc_id, held_out, key of docs(.., text) with n_tokens; sums, shares, known of head words and ends; and log10 of the choices, summed."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = sent.value
        log, share = counts.logs(counts.head, counts.count)
        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(3), 1 << 20):
                h, _, doc = words(data, offsets)
                at, some = counts.in_head(h)
                at, mine, n = at[some], doc[some], hi - lo
                of_head = [np.bincount(mine, x[at].astype(np.float64), n).astype(np.float64) for x in (log, share, counts.count > 0)]
                h, owner, before = stream(h, doc, n)
                logs = np.zeros(len(h))
                for i in range(0, len(h), BATCH):
                    cut = slice(i, i + BATCH)
                    rows, outcome, token = choices(h[cut], [x[cut] for x in before], counts.depth, len(table) - nodes(counts.depth))
                    logs[cut] = np.bincount(token, log_outcomes(table, rows, outcome))
                of_head[0] += np.log10(counts.train + 1)
                of_head[2] += counts.train > 0
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, n) for k in range(3)), pa.array(np.bincount(owner, minlength=n)), *map(pa.array, of_head), pa.array(np.bincount(owner, logs / np.log(10), n))], ["doc_id", "held_out", "key", "n_tokens", "sums", "shares", "known", "logs"])

    return docs.select("doc_id", "held_out", "key", "text").mapInArrow(run, "doc_id long, held_out boolean, key long, n_tokens long, sums double, shares double, known double, logs double")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, key, text; repeated rows have one key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = F.coalesce(kit.remainder(id_col, 7) == 2, F.lit(False))
    key = F.xxhash64(F.lit("row"), F.col(id_col), text)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), key.alias("key"), text.alias("text"))


def fitted(own: DataFrame) -> tuple[Counts, np.ndarray, int]:
    """Counts and weights learned from the rows of keyed() that are not held out, and how many blocks words go to."""
    spark = own.sparkSession
    size = own.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.when(~F.col("held_out"), 1)).alias("train")).first()
    total = size["b"] or 0
    blocks = kit.blocks_for(total // 6, POSTINGS, 16, spark)
    counts = Counts(own, blocks, shape(total // 6)[0], size["train"])
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    weights, _ = trained(own.filter(~F.col("held_out")).select("text").coalesce(tasks), counts.depth, shape(counts.tokens)[1])
    return counts, weights, blocks


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    own = keyed(docs, id_col, text_col)
    counts, weights, blocks = fitted(own)
    rows = kit.stored(head_and_model(own, weights, counts), "rows")
    tail = kit.stored(tail_sums(own, counts, blocks), "tail")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    several = tail.join(copies, "key", "left").select("key", *[(F.col(c) / F.coalesce("copies", F.lit(1))).alias(f"tail_{c}") for c in ("sums", "shares", "known")])
    both = lambda c: F.col(c) + F.coalesce(f"tail_{c}", F.lit(0.0))
    return rows.join(several, "key", "left").select(
        "doc_id", "held_out", "n_tokens", F.round(both("known")).cast("long").alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (both("sums") - F.col("n_tokens") * float(np.log10(counts.tokens + counts.distinct + 1))).alias("base_score"), (both("shares") + F.col("logs")).alias("score"),
    )

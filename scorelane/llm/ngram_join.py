"""N-gram Jaccard join: links between documents that share 75 % of their word shingles.

A document is the set of its distinct 5-word shingles, as 64-bit hashes in ascending
order (an error needs two of them to collide). Equal sets are one class from the
start. The rest is sparse products of the document-by-shingle incidence matrix, taken
block by block of the shingles' hash range, so that neither a document nor a shingle
is ever gathered whole:

1. Bound. Linked sets share at least ceil(3n/4) shingles, so among the first
   n - ceil(3n/4) + l shingles of either, in hash order, at least l are common to both
   (l = n/8). Blocks count, for each set, how many of those prefix shingles occur in
   any other set; sets below their bound link with nothing and are discarded. Of the
   rest all shingles are counted so, and sets with under 3n/4 shared ones discarded.
2. Of each set the rarest shingles are taken, as many as must hold one that a linked
   set takes too. Sets that take the same shingle may link. Where few pairs of a shingle's
   sets are of different components, all of them are candidates; where many are, sets meet two
   pivots of the shingle, and it is left to the next round, when most are of one component.
   The last round takes all pairs that are left, so no link between components is missing.
3. Candidates whose sizes, places in the sets' orders or bit maps (the exclusive or of two
   bounds the shingles they do not share) rule a link out are discarded.
4. Product. Rows of sets and rows of their pivots meet in blocks, one for candidates that
   hang together; a block's overlaps are accumulated over ranges of shingles, and pairs are
   discarded as soon as their sizes rule a link out. Sums reaching 100 * overlap >= 75 *
   union are links.

Components come from star contraction of the links. A class of exact copies or a
group of near copies of any size yields one row a document, never pairs.

Null and empty texts have an empty set and are their own component. Rows with a null
doc_id link like others and name no component, unless it has no other id: then its name is
null. Rows of one doc_id with different texts are different sets. Repeated rows get a row
each. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scorelane.llm import kit

WORDS = 5
MAX_BROADCAST = 1_000_000
POSTINGS = 2_000_000
SLOTS = 1 << 20
#: Rounds with pivots before the one that takes all pairs left, at most; pairs a row of all shingles that a round takes without.
ROUNDS = 3
FEW = 16
#: Shingles of the pivots of a block, ranges of shingles that a product takes one after another,
#: pairs whose sums it holds, and single products that it makes at a time.
PIVOT_SHINGLES = 1 << 18
COLUMNS = 8
CELLS = 1 << 21
PAIRS = 1_000_000
#: Edges that one task contracts.
EDGES = 1 << 20
_C = kit.mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each document, concatenated, and where each begins."""
    data = kit.LOWER[data]
    starts, ends, doc = kit.spans(data, offsets, kit.IS_WORD)
    h = kit.span_hashes(data, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    words = np.diff(first)
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * _C[j]
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    where = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(where[-1], np.uint64)
    for i in range(n):
        a, b = where[i], where[i + 1]
        if words[i] >= k:
            out[a:b] = rolled[first[i] : first[i] + b - a]
        elif words[i]:
            out[a] = np.append(h[first[i] : first[i + 1]] * _C[: words[i]], _C[k : k + 1] * np.uint64(words[i])).sum(dtype=np.uint64)
    out = kit.mixed(out)
    for i in range(n):
        out[where[i] : where[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[where[:-1][where[:-1] < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[where]


def set_ids(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """One 64-bit id per set (never 0), the same for equal sets; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kit.mixed(values ^ _C[9]), dtype=np.uint64)])
    n = np.diff(where).astype(np.uint64)
    ids = kit.mixed(sums[where[1:]] - sums[where[:-1]] + n * _C[10])
    return np.where(n > 0, np.maximum(ids, np.uint64(1)), np.uint64(0)).view(np.int64)


def needed(n: np.ndarray) -> np.ndarray:
    return -(-3 * n // 4)


def _sets(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        for lo, hi, data, offsets in kit.text_chunks(b.column(text)):
            yield b, lo, hi, *shingle_sets(data, offsets)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid of each row of docs(doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, values, where in _sets(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(where)), pa.array(set_ids(values, where))], ["doc_id", "n", "sid"])

    return docs.mapInArrow(run, "doc_id long, n long, sid long")


def _cut(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of ascending values that have any, and the edges of their slices."""
    block = (values >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    return block[edges[:-1]], edges


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1 .. (count[0] of them), first[1], .."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, members and bounds of the distinct sets of documents (text is column 1), by chunk."""
    for _, _, _, values, where in _sets(batches, 1):
        sids, pick = np.unique(set_ids(values, where), return_index=True)
        pick = pick[sids != 0]
        n = where[pick + 1] - where[pick]
        yield sids[sids != 0], values[_ranges(where[pick], n)], np.concatenate([[0], np.cumsum(n)])


def _of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of rows (sid, n, members)."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            p = b.slice(lo, 2000)
            yield p.column(0).to_numpy(), np.frombuffer(b"".join(p.column(2).to_pylist()), np.uint64), np.concatenate([[0], np.cumsum(p.column(1).to_numpy())])


def shared_counts(rows: DataFrame, source: Callable, bits: int, total: int, whole: bool) -> DataFrame:
    """sid, shared: how many shingles of a set (whole, or its prefix) occur in another set's too.

    Counts of a block meet those of the others in groups of sets, sized by the total of
    shingles: more blocks than their number asks for (a wide session) make no more groups.
    """
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sids, values, where in source(batches):
            if not len(sids):
                continue
            n = np.diff(where)
            length = n if whole else np.minimum(n, n - needed(n) + np.maximum(1, n // 8))
            h, owner = values[_ranges(where[:-1], length)], np.repeat(np.arange(len(sids)), length)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            size = np.diff(np.append(new, len(h)))
            local = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(sids))
            h, sid = h[new], np.where(size > 1, 0, sids[owner[new]])
            blocks, edges = _cut(h, bits)
            low = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            rows = [(int(k), low[a:b].tobytes(), sid[a:b].tobytes(), None) for k, a, b in zip(blocks, edges[:-1], edges[1:], strict=True)]
            if local.any():
                rows.append((int(sids[0] & ((1 << bits) - 1)), None, sids[local > 0].tobytes(), local[local > 0].tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "h", "s", "c"])

    def counted(t: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(x for x in t["h"].to_pylist() if x), np.uint32)
        ready = [(s, c) for s, c in zip(t["s"].to_pylist(), t["c"].to_pylist()) if c]
        sid = np.frombuffer(b"".join(s for s, c in zip(t["s"].to_pylist(), t["c"].to_pylist()) if not c), np.int64)
        order = np.lexsort((sid, h))
        h, sid = h[order], sid[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        h, sid = h[new], sid[new]
        first = np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1))
        size = np.diff(np.append(first, len(h)))
        hit = sid[np.repeat(size > 1, size)]
        ids, n = np.unique(hit[hit != 0], return_counts=True)
        ids = np.concatenate([ids, *(np.frombuffer(s, np.int64) for s, _ in ready)])
        n = np.concatenate([n, *(np.frombuffer(c, np.int64) for _, c in ready)])
        group = ids & (groups - 1)
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
        ids, n = ids[order].astype(np.int64), n[order].astype(np.int64)
        cut = [[c[i:e].tobytes() for i, e in zip(edges[:-1], edges[1:], strict=True)] for c in (ids, n)]
        return pa.table({"group": group[order][edges[:-1]], "sids": pa.array(cut[0], pa.binary()), "ns": pa.array(cut[1], pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        ids, back = np.unique(np.frombuffer(b"".join(t["sids"].to_pylist()), np.int64), return_inverse=True)
        n = np.bincount(back, np.frombuffer(b"".join(t["ns"].to_pylist()), np.int64), len(ids))
        return pa.table({"sid": ids, "shared": n.astype(np.int64)})

    groups = 1 << max(6, (total // POSTINGS).bit_length())
    blocks = rows.mapInArrow(postings, "block long, h binary, s binary, c binary")
    partial = blocks.groupBy("block").applyInArrow(counted, "group long, sids binary, ns binary")
    return partial.groupBy("group").applyInArrow(summed, "sid long, shared long")


def sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """sid, n, members (ascending hashes, little-endian) of the chosen(sid, rep) sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, values, where in _sets(batches, 1):
            ids = set_ids(values, where)
            members = [values[a:b].tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(where)), pa.array(members, pa.binary())], ["sid", "n", "members"])

    side = chosen.select(F.col("rep").alias("_rep")).distinct()
    side = F.broadcast(side) if side.count() <= MAX_BROADCAST else side
    wanted = docs.join(side, docs["doc_id"].eqNullSafe(side["_rep"]), "left_semi").select("doc_id", "text").mapInArrow(run, "sid long, n long, members binary")
    return wanted.join(chosen.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def commonness(sets: DataFrame) -> np.ndarray:
    """Upper bounds of the shingles' frequencies in SLOTS slots; SLOTS / 16 of them meet in one task."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for _, values, _ in _of_sets(batches):
            total += np.bincount((values & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(16)), pa.array([x.tobytes() for x in np.split(total, 16)], pa.binary())], ["part", "n"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in t["n"].to_pylist())
        return pa.table({"part": [t["part"][0].as_py()], "n": pa.array([np.minimum(total, 1 << 31).astype(np.uint32).tobytes()], pa.binary())})

    few = sets.select("sid", "n", "members").coalesce(64).mapInArrow(counts, "part long, n binary")
    rows = sorted((r["part"], r["n"]) for r in few.groupBy("part").applyInArrow(added, "part long, n binary").collect())
    return np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for _, x in rows)])


def prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """h, sid, n, i: of each set the shingles, rarest first, of which linked sets share at least one, and their places.

    The order (power of two of the slot's frequency, then hash) is one for all sets; which
    order it is changes the work, not the result.
    """
    level = np.zeros(SLOTS, np.uint8)
    level[: len(common)] = np.log2(np.maximum(common, 1)).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sids, values, where in _of_sets(batches):
            h, n = [np.zeros(0, np.uint64)], np.diff(where)
            rank, length = level[(values & np.uint64(SLOTS - 1)).astype(np.int64)], n - needed(n) + 1
            for i, k in enumerate(length):
                own = values[where[i] : where[i + 1]]
                h.append(own[np.argsort(rank[where[i] : where[i + 1]], kind="stable")[:k]])
            columns = (np.concatenate(h).view(np.int64), np.repeat(sids, length), np.repeat(n, length).astype(np.int32), _ranges(np.zeros_like(length), length).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "sid", "n", "i"])

    return sets.select("sid", "n", "members").mapInArrow(run, "h long, sid long, n int, i int")


def open_pairs(h: np.ndarray, sid: np.ndarray, comp: np.ndarray, n: np.ndarray, i: np.ndarray, few: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs u, v of sets of different components that share one of h, and the h that are left open.

    A shingle with up to `few` such pairs a row gives all of them, but for those that cannot be
    a link's first common shingle: the rest of either set would not reach the overlap that the
    sizes ask for. Others give each row's pairs with two of their rows, and are left open.
    """
    order = np.lexsort((sid, comp, h))
    h, sid, comp, n, i = (x[order] for x in (h, sid, comp, n.astype(np.int64), i.astype(np.int64)))
    rows = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    run = new.copy()
    run[1:] |= comp[1:] != comp[:-1]
    first, start = np.flatnonzero(new), np.flatnonzero(run)
    group, k = np.cumsum(new) - 1, np.diff(np.append(first, len(h)))
    length = np.diff(np.append(start, len(h)))
    count = (np.append(first[1:], len(h)))[group] - np.repeat(start + length, length)  # rows of components after one's own
    cross = np.add.reduceat(count, first) if len(first) else k
    every = cross <= few * k
    names, at = np.unique(sid, return_inverse=True)
    found, held = [np.zeros(0, np.int64)], 0
    left = rows[every[group] & (count > 0)]
    ends, lo = np.cumsum(count[left]), 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        own = left[lo:hi]
        last = np.append(first[1:], len(h))[group[own]]
        a, b = np.repeat(own, count[own]), _ranges(last - count[own], count[own])
        need = needed_overlap(n[a], n[b])
        ok = (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])) & (np.minimum(n[a] - i[a], n[b] - i[b]) >= need)
        a, b = at[a[ok]], at[b[ok]]
        found.append(np.unique(np.maximum(a, b) * len(names) + np.minimum(a, b)))
        held += len(found[-1])
        if held > 4 * PAIRS:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
        lo = hi
    if not every.all():
        most = np.lexsort((-length, group[start]))  # of each shingle the component with the most rows
        most = most[np.searchsorted(group[start][most], np.arange(len(first)))]
        spread = np.lexsort((kit.mixed(sid.astype(np.uint64)), group))[first]
        rest = rows[~every[group]]
        for pivot in (start[most], spread):
            a, b = rest, pivot[group[rest]]
            ok = (comp[a] != comp[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
            found.append(np.unique(at[a[ok]] * len(names) + at[b[ok]]))
    pairs = np.unique(np.concatenate(found))
    return names[pairs // max(len(names), 1)], names[pairs % max(len(names), 1)], h[first[~every]]


def candidates(named: DataFrame, blocks: int, few: float) -> DataFrame:
    """u, v: pairs of sets of named(h, sid, comp, n, i) that may link; h, null: shingles left open, by open_pairs."""
    def run(t: pa.Table) -> pa.Table:
        u, v, h = open_pairs(*(t[c].to_numpy() for c in ("h", "sid", "comp", "n", "i")), few)
        return pa.table({"u": np.concatenate([u, h]), "v": pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(h), pa.int64())])})

    dealt = named.select(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(blocks)).alias("block"), "h", "sid", "comp", "n", "i")
    return dealt.groupBy("block").applyInArrow(run, "u long, v long")


def sketches(sets: DataFrame) -> DataFrame:
    """sid, n, bits: a bit map of each set, of some four bits a shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sids, values, where in _of_sets(batches):
            n, bits = np.diff(where), []
            for i in range(len(sids)):
                size = 1 << min(14, max(9, int(4 * n[i] - 1).bit_length()))
                own = np.zeros(size, bool)
                own[((values[where[i] : where[i + 1]] >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)] = True
                bits.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(n), pa.array(bits, pa.binary())], ["sid", "n", "bits"])

    return sets.select("sid", "n", "members").mapInArrow(run, "sid long, n long, bits binary")


def most_shared(n: np.ndarray, m: np.ndarray, x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Upper bounds of the overlaps of sets of n and m by their bit maps; the longer map is folded to the shorter's length."""
    out = (n + m) // 2
    sizes = np.array([len(b) for b in x], np.int64) << 32 | np.array([len(b) for b in y], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        short = min(int(size) >> 32, int(size) & 0xFFFFFFFF)
        a, b = (np.bitwise_or.reduce(np.frombuffer(b"".join(z[k] for k in at), np.uint64).reshape(len(at), -1, short // 8), axis=1) for z in (x, y))
        out[at] = (n[at] + m[at] - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)) // 2
    return out


def plausible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs(u, v) whose bit maps leave room for a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                n, m = b["n"].to_numpy(), b["m"].to_numpy()
                ok = most_shared(n, m, b["x"].to_pylist(), b["y"].to_pylist()) >= needed_overlap(n, m)
                yield b.select(["u", "v"]).filter(pa.array(ok))

    left, right = maps.toDF("u", "n", "x"), maps.toDF("v", "m", "y")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u long, v long")


def needed_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shingles that sets of n and m must share: 100 * o >= 75 * (n + m - o)."""
    return -(-3 * (n + m) // 7)


def product(u: tuple[np.ndarray, ...], p: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of rows of two blocks, each (sids, sizes, members one after another).

    Entry (i, j) of the product of the incidence matrices is the overlap of row i of u and
    row j of p. It is accumulated over COLUMNS ranges of shingles. After each range pairs are
    discarded whose sum, with all shingles that the smaller rest could still add, stays below
    what their sizes ask for; rows and columns without pairs take no further part.
    """
    (psids, pns, ph), found = p, []
    order = np.argsort(ph, kind="stable")
    ph, powner = ph[order], np.repeat(np.arange(len(psids)), pns)[order]
    edges = (np.arange(1, COLUMNS, dtype=np.uint64) << np.uint64(64 - COLUMNS.bit_length() + 1)).astype(np.uint64)
    pcut = np.concatenate([[0], np.searchsorted(ph, edges), [len(ph)]])
    first = np.concatenate([[0], np.cumsum(u[1])])
    step = max(1, CELLS // max(len(psids), 1))
    for lo in range(0, len(u[0]), step):
        sids, ns = u[0][lo : lo + step], u[1][lo : lo + step]
        h = u[2][first[lo] : first[min(lo + step, len(u[0]))]]
        order = np.argsort(h, kind="stable")
        h, owner = h[order], np.repeat(np.arange(len(sids)), ns)[order]
        cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        need = needed_overlap(ns[:, None], pns[None, :])
        live = (4 * np.minimum(ns[:, None], pns[None, :]) >= 3 * np.maximum(ns[:, None], pns[None, :])) & (sids[:, None] != psids[None, :])
        sums, left, pleft = np.zeros(need.shape, np.int64), ns.copy(), pns.copy()
        for k in range(COLUMNS):
            some, psome = live.any(1), live.any(0)
            if not some.any():
                break
            x, y = slice(cut[k], cut[k + 1]), slice(pcut[k], pcut[k + 1])
            left -= np.bincount(owner[x], minlength=len(ns))
            pleft -= np.bincount(powner[y], minlength=len(pns))
            mine, theirs = some[owner[x]], psome[powner[y]]
            a, row, b, column = h[x][mine], owner[x][mine], ph[y][theirs], powner[y][theirs]
            at = np.searchsorted(b, a, "left")
            count = np.searchsorted(b, a, "right") - at
            shared = np.flatnonzero(count)
            at, count, row = at[shared], count[shared], row[shared]
            ends, i = np.cumsum(count), 0
            while i < len(shared):  # so many products at a time
                e = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                np.add.at(sums.reshape(-1), np.repeat(row[i:e], count[i:e]) * len(pns) + column[_ranges(at[i:e], count[i:e])], 1)
                i = e
            live &= sums + np.minimum(left[:, None], pleft[None, :]) >= need
        i, j = np.nonzero(live)
        found.append((sids[i], psids[j]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect the same: of each u its least v, and that v with the other ones."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(u), 1), bool), u[1:] != u[:-1]]))
    lead = np.repeat(v[new], np.diff(np.append(new, len(u))))
    pairs = np.unique(np.stack([lead, v])[:, lead != v], axis=1)
    return np.concatenate([u[new], pairs[0]]), np.concatenate([v[new], pairs[1]])


def links(sets: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """u, v: edges that connect the linked ones of pairs(u, v), and other linked pairs that meet with them.

    Pairs that hang together have one part, so that a set is moved once; the pivots v of many
    are dealt to several parts by their shingles. A part's pivots are one side of a block; its
    rows are cut so that a block has about POSTINGS shingles of them, whatever their number.
    Blocks are formed by exchange.
    """
    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        blocks = []
        for k in (1, 2):
            own = t.filter(pa.array(side & k > 0))
            blocks.append((np.array(own["sid"].to_numpy(), np.int64), np.array(own["n"].to_numpy(), np.int64), np.frombuffer(b"".join(own["members"].to_pylist()), np.uint64)))
        u, v = spanning(*product(*blocks)) if len(blocks[0][0]) and len(blocks[1][0]) else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": u, "v": v})

    near = components(pairs)
    sizes = sets.select("sid", "n")
    own = pairs.select(F.col("v").alias("sid")).distinct().join(near, "sid").join(sizes, "sid")
    wide = own.groupBy("comp").agg(F.floor(F.sum("n") / PIVOT_SHINGLES).alias("_wide"))
    at = F.pmod(F.xxhash64("comp", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("_wide") + 1)), F.lit(parts))
    pivots = kit.stored(own.join(wide, "comp").select("sid", at.alias("part")), "pivots")
    rows = kit.stored(pairs.join(pivots.toDF("v", "part"), "v").select(F.col("u").alias("sid"), "part").distinct(), "met")
    sized = kit.stored(rows.join(sizes, "sid").groupBy("part").agg(F.floor(F.sum("n") / POSTINGS).alias("_last")), "parts")
    few = F.broadcast(sized) if parts <= MAX_BROADCAST else sized
    left = rows.join(few, "part").select("sid", "part", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("_last") + 1).alias("cut"), F.lit(1).alias("side"))
    right = pivots.join(few, "part").select("sid", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("cut"), F.lit(2).alias("side"))
    whole = left.union(right).groupBy("sid", "part", "cut").agg(F.bit_or("side").alias("side"))
    whole = whole.join(sets.select("sid", "n", "members"), "sid").select("part", "cut", "side", "sid", "n", "members")
    found = kit.stored(whole.groupBy("part", "cut").applyInArrow(run, "u long, v long"), "links")
    kit.release(near, pivots, rows, sized)
    return found


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges u, v in ascending order and, of each, the least node reachable."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label, a, b = np.arange(len(names)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return names, names[label]


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """sid, comp: the least node reachable over edges(u, v), for nodes that have any; star contraction.

    Tasks of about `most` edges each first contract what they hold. Where that took more than one
    task, rounds make large stars, then small stars, until the edges are few enough for one task, or
    a round leaves them as they were, by their number and two sums of hashes, which are observed as
    they are written.
    """
    def contracted(df: DataFrame, tasks: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(ends or [np.zeros(0, np.int64)] * 2))], ["sid", "comp"])

        return df.filter("u != v").select("u", "v").coalesce(tasks).mapInArrow(run, "sid long, comp long")

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        sums = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
        found = kit.stored(df.filter("u != v").distinct().observe(seen, F.count("*").alias("n"), *sums), "edges")
        return found, tuple(seen.get.values())

    tasks = 1 + edges.count() // most
    if tasks == 1:
        return kit.stored(contracted(edges, 1), "label")
    edges, state = kept(contracted(edges, tasks).toDF("u", "v"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")
        large = kit.stored(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after, now = kept(small)
        kit.release(edges, large)
        edges, before, state = after, state, now
        if state == before or state[0] < most:
            whole = contracted(edges, 1) if state[0] < most else edges.toDF("sid", "comp").union(edges.select(F.col("v").alias("sid"), F.col("v").alias("comp")).distinct())
            found = kit.stored(whole, "label")
            kit.release(edges)
            return found


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = kit.stored(described(docs), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (kit.blocks_for(total, POSTINGS, 16, spark) * 2 - 1).bit_length())
    classes = kit.stored(rows.filter("sid != 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    bound = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 3 / 4) / 8))
    alive = shared_counts(docs, _of_texts, bits, total, False).join(classes, "sid").filter(F.col("shared") >= bound)
    alive = kit.stored(alive.select("sid", "rep"), "alive")
    every = kit.stored(sets_of(docs, alive), "sets")
    kit.release(alive)
    total = every.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (kit.blocks_for(total, POSTINGS, 16, spark) * 2 - 1).bit_length())
    shared = shared_counts(every, _of_sets, bits, total, True)
    sets = kit.stored(every.join(shared, "sid").filter(4 * F.col("shared") >= 3 * F.col("n")).select("sid", "n", "members"), "sets")
    kit.release(every)
    parts = 1 + (sets.agg(F.sum("n")).first()[0] or 0) // PIVOT_SHINGLES
    held = kit.stored(prefixes(sets, commonness(sets)), "held")
    label = joined(sets, held, parts)
    kit.release(held, sets)
    named = label.join(classes, "sid")
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    of = kit.stored(classes.join(label, "sid", "left").join(least, "comp", "left").select("sid", F.coalesce("least", "rep").alias("component_id")), "of")
    kit.release(label, classes)
    kit.tidy(spark)
    whole = rows.join(of, "sid", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def joined(sets: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """sid, comp: components of the links of all sets; held(h, sid, n, i): the shingles of which linked sets share one."""
    spark = sets.sparkSession
    maps = kit.stored(sketches(sets), "maps")
    label, left, total = None, held, held.count()
    for step in range(ROUNDS + 1):
        if label is None:
            named = left.withColumn("comp", F.col("sid"))
        else:
            named = left.join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        rows = left.count()
        few = FEW * total / max(rows, 1) if step < ROUNDS else float("inf")  # few rows left may have more pairs each
        found = kit.stored(candidates(named, kit.blocks_for(rows, POSTINGS // 8, 16, spark), few), "candidates")
        pairs = kit.stored(plausible(found.filter("v IS NOT NULL").distinct(), maps), "pairs")
        new = links(sets, pairs, parts)
        after = components(new if label is None else new.union(label.select(F.col("sid").alias("u"), F.col("comp").alias("v"))))
        rest = left.join(found.filter("v IS NULL").select(F.col("u").alias("h")), "h", "left_semi").select("h", "sid", "n", "i")
        rest = kit.stored(rest, "open")
        kit.release(new, pairs, found, *([label] if label else []), *([left] if left is not held else []))
        kit.tidy(spark)
        label, left = after, rest
        if left.isEmpty():  # of every shingle all pairs of different components were candidates
            break
    kit.release(maps, left)
    return label


def deduplicated(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least doc_id (null ones last), all columns.

    Components are of rows, by a number each row is given: rows with a null or the same
    doc_id are told apart. Rows with an empty set are copies of each other if their id is
    the same, null included, and their text is.
    """
    row = kit.unused(docs, "row")
    own = kit.numbered(docs, row)
    found = ngram_components(own, id_col=row).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_comp"), F.col("n_shingles").alias("_n"))
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    keys = own.select(F.col(row).alias("_row"), id_.alias("_id"), F.sha2(text, 256).alias("_s")).join(found, "_row")
    empty = F.col("_n") == 0
    group = [F.when(~empty, F.col("_comp")).alias("_c"), *[F.when(empty, F.col(c)).alias(c + "e") for c in ("_id", "_s")]]
    kept = keys.groupBy(*group).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("least")).select(F.col("least._row").alias(row))
    return own.join(kit.stored(kept, "kept"), row, "left_semi").drop(row)

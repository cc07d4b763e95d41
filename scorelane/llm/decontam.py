"""Benchmark decontamination with a positional inverted index.

The index is a table with one row per chunk of documents: the chunk's documents, their
token counts, and for each indexed term the ascending positions of its tokens in the
chunk (documents are set apart by a gap no match can cross). Terms are 64-bit word
hashes. Only terms of the test items are stored unless terms is None, so postings grow
with the corpus but stay a fraction of it. A search runs over the index rows where they
lie: per chunk each window takes the positions of its rarest term, shifts them by the
term's offset, and intersects them with the other terms' lists from rare to common. The
match is exact phrase, or, with slack > 0, the terms in order within slack extra words.

Test items are sent to the executors in blocks of at most BLOCK_BYTES of text; more
items take more passes over the one stored index, whose chunks are named, so that the
results of the passes meet by chunk and place in it, whatever the documents' ids are.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Null and
empty texts have none; an item without words matches nothing, a null item_id is
ignored, items with the same id are one item. Documents with a null id and repeated rows
get a row each. Without documents or items the result is empty or has no hits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm import kit

WINDOW = 10
BLOCK_BYTES = 16 << 20
_SHIFT = 40
#: Fixed value of the contract.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

INDEX = "chunk string, doc_id array<bigint>, n_words binary, begins binary, terms binary, edges binary, places binary"


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class Windows:
    """Windows of some items: term numbers (-1 beyond the end), lengths, items."""

    def __init__(self, items: list[tuple[str, str | None]], length: int = WINDOW) -> None:
        words = [(i, w) for i, text in items if (w := item_words(text))]
        self.names = sorted({i for i, _ in words})
        place = {x: k for k, x in enumerate(self.names)}
        vocabulary = sorted({x for _, w in words for x in w})
        hashes = np.array([kit.hash_of(x) for x in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        number = {vocabulary[k]: i for i, k in enumerate(order)}
        found = sorted({(place[i], *(number[x] for x in w[a : a + length])) for i, w in words for a in range(max(1, len(w) - length + 1))})
        self.item = np.array([x[0] for x in found], np.int64)
        self.size = np.array([len(x) - 1 for x in found], np.int64)
        self.term = np.full((len(found), length), -1, np.int64)
        for k, x in enumerate(found):
            self.term[k, : len(x) - 1] = x[1:]


def build_index(docs: DataFrame, terms: np.ndarray | None, gap: int = 64) -> DataFrame:
    """The index of docs(doc_id, text); terms: ascending hashes to store, all if None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in kit.text_chunks(b.column(1)):
                data = kit.LOWER[data]
                starts, ends, doc = kit.spans(data, offsets, kit.IS_ALNUM)
                h = kit.span_hashes(data, starts, ends)
                n = np.bincount(doc, minlength=hi - lo)
                begins = np.concatenate([[0], np.cumsum(n + gap)[:-1]])
                place = np.arange(len(h)) + doc * gap
                if terms is not None:
                    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
                    known = terms[at] == h if len(terms) else np.zeros(len(h), bool)
                    h, place = h[known], place[known]
                order = np.argsort(h, kind="stable")
                h, place = h[order], place[order]
                edges = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
                row = (uuid.uuid4().hex, b.column(0).slice(lo, hi - lo).to_pylist(), *(x.tobytes() for x in (n.astype(np.int64), begins.astype(np.int64), h[edges], np.append(edges, len(h)).astype(np.int64), place.astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5), strict=True)], ["chunk", "doc_id", "n_words", "begins", "terms", "edges", "places"])

    return docs.mapInArrow(run, INDEX)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)


def intersect(windows: Windows, terms: np.ndarray, edges: np.ndarray, places: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, first and last positions of all matches in one chunk's postings."""
    nothing = (np.zeros(0, np.int64),) * 3
    if not len(terms) or not len(windows.item):
        return nothing
    count = np.zeros(len(windows.vocabulary) + 1, np.int64)  # the last: no term
    first = np.zeros_like(count)
    at = np.minimum(np.searchsorted(windows.vocabulary, terms), len(windows.vocabulary) - 1)
    mine = np.flatnonzero(windows.vocabulary[at] == terms)
    count[at[mine]], first[at[mine]] = np.diff(edges)[mine], edges[mine]
    number = np.full(len(terms), -1, np.int64)
    number[mine] = at[mine]
    keys = (np.repeat(number, np.diff(edges)) << _SHIFT) | places
    keys, places, dropped = keys[keys >= 0], places, 0  # terms of other blocks have number -1
    length = np.where(windows.term >= 0, count[windows.term], np.iinfo(np.int64).max)
    alive = np.flatnonzero(length.min(1) > 0)
    if not len(alive):
        return nothing
    if slack:
        lead = windows.term[alive, 0]
        n = count[lead]
        w = np.repeat(alive, n)
        start = places[np.repeat(first[lead] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
        last = start.copy()
        for j in range(1, windows.term.shape[1]):
            t = windows.term[w, j]
            nxt = np.searchsorted(keys, (np.maximum(t, 0) << _SHIFT) | (last + 1))
            ok = (t < 0) | ((nxt < len(keys)) & (keys[np.minimum(nxt, len(keys) - 1)] >> _SHIFT == t))
            last = np.where(t < 0, last, keys[np.minimum(nxt, len(keys) - 1)] & ((1 << _SHIFT) - 1))[ok]
            w, start = w[ok], start[ok]
            near = last - start < windows.size[w] + slack
            w, start, last = w[near], start[near], last[near]
        return w, start, last
    rare = np.argsort(length[alive], 1, kind="stable")
    lead = windows.term[alive, rare[:, 0]]
    n = count[lead]
    w, rank = np.repeat(alive, n), np.repeat(np.arange(len(alive)), n)
    start = places[np.repeat(first[lead] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64) - rare[rank, 0]
    w, rank, start = w[start >= 0], rank[start >= 0], start[start >= 0]
    for j in range(1, windows.term.shape[1]):
        offset = rare[rank, j]
        t = windows.term[w, offset]
        ok = (t < 0) | _among(keys, (np.maximum(t, 0) << _SHIFT) | (start + offset))
        w, rank, start = w[ok], rank[ok], start[ok]
    return w, start, start + windows.size[w] - 1


def search(index: DataFrame, windows: Windows, slack: int = 0) -> DataFrame:
    """Per document of the index: its chunk and place there, n_words, items (sorted names), spans [first, end) of words in matches, merged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, begins, terms, edges, places = (np.frombuffer(r[k], t) for k, t in (("n_words", np.int64), ("begins", np.int64), ("terms", np.uint64), ("edges", np.int64), ("places", np.uint32)))
                w, start, last = intersect(windows, terms, edges, places, slack)
                doc = np.searchsorted(begins, start, "right") - 1
                spans: list[list] = [[] for _ in n]
                items: list[set] = [set() for _ in n]
                for k in np.lexsort((last, start)):
                    d = doc[k]
                    a, e = int(start[k] - begins[d]), int(last[k] - begins[d]) + 1
                    items[d].add(windows.names[windows.item[w[k]]])
                    if spans[d] and a <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(e, spans[d][-1]["end"])
                    else:
                        spans[d].append({"first": a, "end": e})
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([r["chunk"]] * len(n), range(len(n)), r["doc_id"], n, [sorted(x) for x in items], spans), kinds, strict=True)], ["chunk", "place", "doc_id", "n_words", "items", "spans"])

    return index.mapInArrow(run, "chunk string, place long, doc_id long, n_words long, items array<string>, spans array<struct<first:long,end:long>>")


def blocks_of(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about `most` bytes of text, split by the hash of the id."""
    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i is not null")
    n = max(1, -(-(own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // most))
    for k in range(n):
        yield [(r["i"], r["t"]) for r in own.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slack: int = 0) -> DataFrame:
    """doc_id, n_words, items, spans of each document, over all blocks of items."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = lambda: (Windows(x, window) for x in blocks_of(items, item_col, item_text_col, BLOCK_BYTES))
    terms, n = np.zeros(0, np.uint64), 0
    for windows in blocks():
        terms, n = np.union1d(terms, windows.vocabulary), n + 1
    index = kit.stored(build_index(docs, terms), "index")
    if n == 1:
        return search(index, windows, slack).drop("chunk", "place")
    found = None
    for windows in blocks():
        part = kit.stored(search(index, windows, slack), "found")
        found = part if found is None else kit.stored(_both(found, part), "found")
    return found.drop("chunk", "place")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Results of two blocks over the same rows of the index."""
    union = a.union(b).groupBy("chunk", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    last = F.struct(F.col("spans"))
    merge = lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["first"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s)))
    return union.withColumn("spans", F.aggregate(last["spans"], F.array().cast("array<struct<first:bigint,end:bigint>>"), merge))


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
occurs AS (SELECT r, p, x.k, item_id FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows))) x JOIN windows USING (k, phrase)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM occurs) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM occurs) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""

"""Sharding by histogram sort.

Documents are ordered by a 62-bit key (38 bits of the text's hash, then 24 of the
id's, so equal texts lie together and a large group of copies can still be cut).
Splitters are found by counting: each pass sums exact bytes below the edges of a
grid of probes, and only the grid cells that hold a target are probed more finely in
the next one, until every splitter is within tolerance of its share or single keys
are told apart. A second search by rows cuts the key range into pieces small enough
for one task. Then rows cross the network once, by piece, and get their slots from a
row number within the piece plus the counts of the pieces before it.

A pass moves at most (open cells) x 2**PROBE_BITS sums; only those reach the driver.

Empty tables give no rows. Null texts count as empty, null ids sort first, repeated
rows each get a slot of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelane.llm import kit

KEY_BITS = 62
PROBE_BITS = 11


def keyed(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 26), 24) + F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 24) - 1))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )


def splitters(rows: DataFrame, weight: F.Column, parts: int, tolerance: float) -> list[int]:
    """parts - 1 keys: part j holds the keys from splitter j - 1 up to below splitter j."""
    found: dict[int, int] = {}
    total, bits = None, KEY_BITS
    open_cells: dict[int, tuple[int, list[int]]] = {}  # cell -> (weight below it, targets inside)
    while bits > 0 and (total is None or open_cells):
        step = min(PROBE_BITS, bits)
        source = rows if total is None else rows.filter(F.shiftright("key", bits).isin(list(open_cells)))
        bits -= step
        sums = sorted((int(r["cell"]), int(r["w"])) for r in source.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.sum(weight).alias("w")).collect())
        if total is None:
            total = sum(w for _, w in sums)
            open_cells = {0: (0, list(range(1, parts)))}
            step = KEY_BITS
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for cell, w in sums:
            by_parent.setdefault(cell >> step, []).append((cell, w))
        nearer: dict[int, tuple[int, list[int]]] = {}
        for parent, (below, targets) in open_cells.items():
            cells = by_parent.get(parent, [])
            edges = np.array([below, *(below + np.cumsum([w for _, w in cells]))], np.int64)
            for j in targets:
                goal = total * j / parts
                i = min(max(int(np.searchsorted(edges, goal, "right")) - 1, 0), max(len(cells) - 1, 0))
                if not cells:
                    found[j] = parent << (bits + step)
                    continue
                low, high = goal - edges[i], edges[i + 1] - goal
                if min(low, high) <= tolerance * total / parts or not bits:
                    found[j] = (cells[i][0] if low <= high else cells[i][0] + 1) << bits
                else:
                    nearer.setdefault(cells[i][0], (int(edges[i]), []))[1].append(j)
        open_cells = nearer
    return [found[j] for j in sorted(found)]


def shards(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 1e-4, piece_rows: int = 250_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: this law has none)."""
    rows = kit.stored(keyed(docs, id_col, text_col, overhead), "keys")
    outer = splitters(rows, F.col("size"), n_shards, tolerance)
    pieces = kit.blocks_for(rows.count(), piece_rows, 4 * n_shards, docs.sparkSession)
    inner = splitters(rows, F.lit(1), pieces, 0.1)
    edges = np.array(sorted({*outer, *inner}), np.int64)
    outer_edges = np.array(outer, np.int64)
    shard_of = np.searchsorted(outer_edges, np.concatenate([[-1], edges]), "right")

    def placed(key: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, key, "right")

    def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            piece, n = np.unique(placed(b["key"].to_numpy()), return_counts=True)
            yield pd.DataFrame({"piece": piece, "n": n})

    counts = np.zeros(len(edges) + 1, np.int64)
    for r in rows.select("key").mapInPandas(pieces_of, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r["piece"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    base = before - before[np.searchsorted(shard_of, shard_of, "left")]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            piece = placed(b["key"].to_numpy())
            yield b.assign(piece=piece, shard=shard_of[piece].astype(np.int32), base=base[piece])

    wide = rows.mapInPandas(dealt, "doc_id long, size long, text_crc32 long, key long, piece long, shard int, base long")
    within = Window.partitionBy("piece").orderBy("key", "doc_id", "text_crc32")
    return wide.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Exact top-k by inner product: tiled matrix products and merged top lists.

Vectors are packed into shards of rows; queries into blocks.  A tile is one block times
one shard: one matrix product, then a partial selection of each query's k best.  A task
merges the tiles of its (block, shard group); group lists are merged as a tree, ``fan``
lists at a time.  Blocks and groups meet in a hash join on their numbers, so each query
sees each row once and no task holds more than one block, one shard and their lists.

Components become floor(256 x), kept as whole-numbered doubles.  A product is taken in
floating point where its bound shows that it is exact, and with Python integers beyond.

Defined cases: rows with a null id, a null vector or a null or non-finite component
(after scaling, too) take no part; rows of a query's own id are never its candidates; a
candidate of another length than the query is none; repeated rows each count as
candidates, and each as a query; scores beyond a long count as its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlake.llm.common import ship, stored

PACKED = "dim int, keys binary, ids binary, data binary"
EXACT = float(1 << 53)
LONG = -(1 << 63), (1 << 63) - 1


def _finite(x: Column) -> Column:
    scaled = 256 * x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(scaled) != F.lit(math.inf))


def _numbers(n: int) -> Column:
    """0 to n - 1, as longs."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _pack(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """Rows (key, id, vec) as matrices of up to ``size`` rows of one length (and one ``by``),
    ids ascending."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out(at: tuple, got: list) -> pa.RecordBatch:
            got.sort(key=lambda r: r[1])
            data = np.floor(256 * np.array([r[2] for r in got], "<f8").reshape(len(got), at[0]))
            cells = [pa.array([at[0]], pa.int32()),
                     *(pa.array([np.array([r[i] for r in got], "<i8").tobytes()], pa.binary())
                       for i in (0, 1)), pa.array([data.tobytes()], pa.binary())]
            names = ["dim", "keys", "ids", "data"]
            if by:
                cells, names = [pa.array([at[1]], pa.int64()), *cells], [by, *names]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            places = batch[by].to_pylist() if by else [0] * len(batch)
            for key, i, vec, place in zip(batch["key"].to_pylist(), batch["id"].to_pylist(),
                                          batch["vec"].to_pylist(), places):
                got = held.setdefault((len(vec), place), [])
                got.append((key, i, vec))
                if len(got) == size:
                    yield out((len(vec), place), held.pop((len(vec), place)))
        for at, got in held.items():
            yield out(at, got)

    return rows.mapInArrow(pack, f"{by} long, {PACKED}" if by else PACKED)


def tile_top(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(query position, candidate id, score) of each query's k best in one tile; c_ids
    ascending."""
    if not len(c) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    n, own = len(c), q_ids[:, None] == c_ids[None, :]
    bound = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if (bound + 1) * n < EXACT:
        score = q @ c.T
        rank = score * n + (n - 1 - np.arange(n))  # ties to the smaller id
        rank[own] = -np.inf
        k = min(k, n)
        at = np.argpartition(-rank, k - 1, axis=1)[:, :k]
    else:
        whole = np.vectorize(int, otypes=[object])
        score = whole(q) @ whole(c).T if q.shape[1] else np.zeros((len(q), n), object)
        score = np.clip(score, *LONG)
        k = min(k, n)
        at = np.array([sorted(np.flatnonzero(~o), key=lambda j: -s[j])[:k]
                       + [j for j in np.flatnonzero(o)][:max(0, k - int((~o).sum()))]
                       for s, o in zip(score, own)]).reshape(len(q), -1)
    pos = np.repeat(np.arange(len(q)), at.shape[1])
    at = at.ravel()
    good = ~own[pos, at]
    pos, at = pos[good], at[good]
    return pos, c_ids[at], [int(x) for x in score[pos, at]]


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding", block_rows: int = 1024, shard_rows: int = 2048,
          shards_per_group: int = 16, fan: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates."""
    ship(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
                    & F.forall(vec_col, _finite)).withColumn("_query", is_query).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
        "_query")
    asked = stored(rows.where("_query").select(F.monotonically_increasing_id().alias("key"),
                                               "id", "vec"), "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    packed = _pack(asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
                   .repartition("block"), block_rows, "block")
    shards = stored(_pack(rows.select(F.lit(0).cast("long").alias("key"), "id", "vec"),
                          shard_rows).withColumn("uid", F.monotonically_increasing_id()), "shards")
    groups = max(1, -(-shards.count() // shards_per_group))
    each = shards.select(
        "dim", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"),
        F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"),
        F.explode(_numbers(blocks)).alias("block"))
    tiles = packed.withColumn("grp", F.explode(_numbers(groups))).join(
        each, ["block", "grp", "dim"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = {c: batch[c][i].as_buffer() if c in ("keys", "ids", "data", "c_ids", "c_data")
                     else batch[c][i].as_py() for c in batch.schema.names}
                keys, q_ids, c_ids = (np.frombuffer(x[c], "<i8") for c in ("keys", "ids", "c_ids"))
                q, c = (np.frombuffer(x[n], "<f8").reshape(-1, x["dim"]) if x["dim"]
                        else np.zeros((m, 0)) for n, m in (("data", len(q_ids)),
                                                           ("c_data", len(c_ids))))
                pos, ids, score = tile_top(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[pos], pa.int64()), pa.array(q_ids[pos], pa.int64()),
                     pa.array([x["grp"]] * len(pos), pa.int64()), pa.array(ids, pa.int64()),
                     pa.array(score, pa.int64())],
                    ["key", "query_id", "grp", "vec_id", "score"])

    lists = tiles.select("dim", "grp", "keys", "ids", "data", "c_ids", "c_data").mapInArrow(
        products, "key long, query_id long, grp long, vec_id long, score long")
    while True:
        last = groups <= fan
        best = Window.partitionBy("key", *([] if last else ["grp"])).orderBy(
            F.desc("score"), "vec_id")
        groups = -(-groups // fan)
        lists = lists.withColumn("grp", F.floor(F.col("grp") / fan).cast("long")).withColumn(
            "rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if last:
            return lists.select("query_id", "rank", "vec_id", "score")

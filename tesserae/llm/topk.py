"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Vectors become integers. In each block of candidates, a component's impact is quantised
to its number of bits; all postings of one impact are a segment, and segments are kept by
descending impact. For a block of queries the segments are processed in that order. After
each, what is still missing from a score is at most the product of the query's norm and
the norm of the candidate's unprocessed components, which gives every candidate a lower
and an upper bound. A query stops when the candidates whose upper bound reaches the k-th lower
bound are few; only those are possible members, by proof, and they are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialise

#: Candidates and queries in a block.
BLOCK, QUERIES = 8192, 2048
#: Possible members per result at which a query stops early.
FEW = 4
#: Queries processed at a time within a block.
AT_ONCE = 256


def _packed(batches):
    """Sorted (block, id, ints) -> a row a block: (block, ids, ints, dim)."""

    def row(block, ids, vectors):
        dim = max(map(len, vectors))
        ints = np.zeros((len(vectors), dim), np.int64)
        for n, v in enumerate(vectors):
            ints[n, : len(v)] = v
        return {"block": block, "ids": np.array(ids, np.int64).tobytes(), "ints": ints.tobytes(), "dim": dim}

    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("ints", pa.binary()), ("dim", pa.int32())])
    now, ids, vectors = None, [], []
    for batch in batches:
        for block, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if block != now and ids:
                yield pa.RecordBatch.from_pylist([row(now, ids, vectors)], schema)
                ids, vectors = [], []
            now = block
            ids.append(i)
            vectors.append(v)
    if ids:
        yield pa.RecordBatch.from_pylist([row(now, ids, vectors)], schema)


class Index:
    """Impact-ordered segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray):
        self.ids, self.ints = ids, ints
        impact = np.zeros(ints.shape, np.int64)
        size = np.abs(ints)
        while (size >> impact).any():
            impact += (size >> impact) > 0
        self.segments = []
        rest = ints.copy()
        for level in sorted(set(impact[impact > 0].tolist()), reverse=True):
            part = np.where(impact == level, ints, 0)
            rest = rest - part
            # Rounded up, so that the bound holds in floating point.
            left = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
            self.segments.append((part, left))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, id, score) arrays: each query's k best other candidates, ties to the smaller id."""
        dim = max(queries.shape[1], self.ints.shape[1])
        pad = lambda x: np.pad(x, ((0, 0), (0, dim - x.shape[1])))
        queries, ints = pad(queries), pad(self.ints)
        # Exact in floating point while no partial sum can leave the significand.
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(ints).max(initial=0)) * dim
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        parts = [(np.ascontiguousarray(pad(p).T.astype(kind)), left) for p, left in self.segments]
        for at in range(0, len(queries), AT_ONCE):
            yield from self._batch(query_ids[at : at + AT_ONCE], queries[at : at + AT_ONCE], ints, parts, kind, k)

    def _batch(self, query_ids, queries, ints, parts, kind, k):
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        cast = queries.astype(kind)
        open_ = np.arange(len(queries))
        scores = np.zeros((len(queries), len(ints)), kind)
        own = self.ids[None, :] == query_ids[:, None]
        n = min(k, len(ints))
        for step, (part, left) in enumerate(parts):
            scores += cast[open_] @ part
            last = step == len(parts) - 1
            if not last and step < 1:
                continue  # bounds are too wide to be worth computing
            slack = np.zeros_like(scores, np.float64) if last else norms[open_, None] * left[None, :]
            low = np.where(own[open_], -np.inf, scores - slack)
            reach = np.partition(low, len(ints) - n, axis=1)[:, len(ints) - n] if n else np.zeros(len(open_))
            possible = (scores + slack >= reach[:, None]) & ~own[open_]
            done = last | (possible.sum(axis=1) <= FEW * k)
            for row in np.flatnonzero(done):
                q, members = open_[row], np.flatnonzero(possible[row])
                exact = ints[members] @ queries[q]
                top = np.lexsort((self.ids[members], -exact))[:k]
                yield query_ids[q], self.ids[members[top]], exact[top]
            open_, scores = open_[~done], scores[~done]
            if not len(open_):
                return
        if not parts:
            for q in range(len(queries)):
                members = np.flatnonzero(~own[q])
                top = np.argsort(self.ids[members], kind="stable")[:k]
                yield query_ids[q], self.ids[members[top]], np.zeros(len(top), np.int64)


def _searched(k: int):
    def run(batches):
        last, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last:
                    ints = np.frombuffer(row["ints"], np.int64).reshape(-1, row["dim"])
                    last, index = row["block"], Index(np.frombuffer(row["ids"], np.int64), ints)
                queries = np.frombuffer(row["q_ints"], np.int64).reshape(-1, row["q_dim"])
                out = [[], [], []]
                for q, ids, scores in index.search(np.frombuffer(row["q_ids"], np.int64), queries, k):
                    out[0].append(np.full(len(ids), q))
                    out[1].append(ids)
                    out[2].append(scores)
                arrays = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in out]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); scores are integer inner products, ties go to
    the smaller vec_id. Queries are the rows whose id is divisible by ``every``, candidates
    all rows but the query's own. Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part. Every row of a repeated id is a candidate, for other ids'
    queries; as a query the smallest vector counts. Vectors of different lengths are compared as if zeros followed the shorter. An empty table
    gives no rows. Components must be below 2**57 / scale so that integers hold them.
    """
    x = F.transform(vectors[vector_col], lambda v: v.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("ints"))
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))

    def packed(rows: DataFrame, count: int, tag: str) -> DataFrame:
        rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block"), "id", "ints")
        return materialise(rows.repartition(count, "block").sortWithinPartitions("block", "id", "ints").mapInArrow(_packed, "block long, ids binary, ints binary, dim int"), tag)

    candidates = packed(rows, blocks, "candidates").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("ints").alias("ints"))
    queries = packed(asked, parts, "queries").toDF("part", "q_ids", "q_ints", "q_dim")
    # A query block meets each candidate block once, in whatever task.
    met = candidates.join(queries, "part").repartition(blocks * parts, "block", "part").sortWithinPartitions("block")
    found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

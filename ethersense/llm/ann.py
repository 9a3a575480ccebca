"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.llm.textwork import mix64, signed
from ethersense.llm.vectors import deal, matrix, nearest, usable
from ethersense.session import materialise

SCHEMA = "query_id long, vec_id long, score double"
#: Queries scored at a time inside a task.
CHUNK = 256
#: Rows are hashed in bands whose norms differ by at most this factor, each with its own scale.
BAND_RATIO = 1.5


class _Tables:
    """``tables`` groups of ``hashes`` Gaussian projections, cut into cells of ``width`` times the largest norm of a band."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((dim + 1, tables * hashes))
        self.b = rng.random(tables * hashes)
        self.tables, self.hashes, self.width = tables, hashes, width
        moves = np.array(list(product((0, -1, 1), repeat=hashes)))
        self.moves, self.down, self.up = moves, (moves == -1).astype(float), (moves == 1).astype(float)

    def places(self, x: np.ndarray, log_norm: float, query: bool) -> np.ndarray:
        """Position on every projection in cells; inner product becomes distance by one more component.

        Lengths are kept as logarithms, so vectors of any finite size have one."""
        most = np.abs(x).max(axis=1, keepdims=True)
        x = x / most
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            x, extra = x / size, np.zeros_like(size)
        else:
            share = np.exp(np.log(most) + np.log(size) - log_norm)
            x, extra = x / size * share, np.sqrt(np.maximum(0.0, 1 - share**2))
        return (np.hstack([x, extra]) @ self.a) / self.width + self.b

    def bucket(self, cells: np.ndarray, table: int, band: int) -> np.ndarray:
        h = np.full(cells.shape[:-1], table + 1 + (band << 16), np.uint64)
        for i in range(self.hashes):
            h = mix64(h + cells[..., i].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return signed(h)

    def probes(self, place: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` cells most likely to hold near rows: least summed squared distance to their edges."""
        cell = np.floor(place)
        off = place - cell
        cost = off**2 @ self.down.T + (1 - off) ** 2 @ self.up.T
        best = np.argsort(cost, axis=1, kind="stable")[:, :count]
        return cell[:, None, :] + self.moves[best]


def _hash_rows(make, bands: dict, probes: int):
    """Buckets of each row: its own one per table, or with ``probes`` the cells that its search visits in every band.

    ``bands`` has for each number of components {band: logarithm of the largest norm, or None where all rows lie in one bucket}.
    """

    def run(batches):
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                part = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
                tables, own_band = make(dim), np.asarray(part.column("band"))
                for band, norm in bands[dim].items():
                    mine = part if probes else part.filter(pa.array(own_band == band))
                    if not mine.num_rows:
                        continue
                    x = matrix(mine.column("x"))
                    place = None if norm is None else tables.places(x, norm, bool(probes))
                    for t in range(tables.tables if norm is not None else 1):
                        if norm is None:
                            cells = np.zeros((len(x), 1, tables.hashes))
                        else:
                            own = place[:, t * tables.hashes : (t + 1) * tables.hashes]
                            cells = tables.probes(own, probes) if probes else np.floor(own)[:, None, :]
                        bucket = tables.bucket(cells, t, band)
                        row = pa.array(np.repeat(np.arange(len(x)), bucket.shape[1]))
                        yield pa.record_batch([
                            mine.column("vec_id").take(row), mine.column("dim").take(row), pa.array(np.full(len(row), t, np.int32)),
                            pa.array(bucket.reshape(-1)),
                        ], names=["vec_id", "dim", "table", "bucket"])

    return run


def _scores(x: np.ndarray, q: np.ndarray, bucket: np.ndarray, asker: np.ndarray, visited: np.ndarray, first: int):
    """The scores of up to ``CHUNK`` queries from number ``first`` on with the rows they visit, else minus infinity."""
    if not len(asker):
        return
    order = np.argsort(visited, kind="stable")
    asker, visited = asker[order], visited[order]
    scores = np.full((min(CHUNK, len(q) - first), len(x)), -np.inf)
    rows = np.argsort(bucket, kind="stable")
    there = bucket[rows]
    for b in np.unique(visited):
        at = rows[np.searchsorted(there, b, side="left") : np.searchsorted(there, b, side="right")]
        if len(at):
            who = asker[np.searchsorted(visited, b, side="left") : np.searchsorted(visited, b, side="right")]
            scores[np.ix_(who - first, at)] = np.maximum(q[who] @ x[at].T, -np.finfo(float).max)  # visited, however far
    for i in np.unique(asker):
        yield i, scores[i - first]


def _rerank(k: int):
    """Exact inner products of the queries with the rows of the buckets they visit."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, near, score = [], [], []
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("x")), matrix(right.column("x"))
            x_id, q_id = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
            bucket = np.asarray(left.column("bucket"))
            visits = right.column("buckets").combine_chunks()
            asker = np.repeat(np.arange(len(q)), np.asarray(visits.value_lengths()))
            visited = np.asarray(visits.flatten())
            edges = np.searchsorted(asker, np.arange(0, len(q) + CHUNK, CHUNK))
            for lo, hi in zip(edges, edges[1:]):
                first = int(asker[lo]) // CHUNK * CHUNK if hi > lo else 0
                for i, some in _scores(x, q, bucket, asker[lo:hi], visited[lo:hi], first):
                    some[x_id == q_id[i]] = -np.inf
                    live = np.flatnonzero(some > -np.inf)
                    if len(live) > k:
                        bar = np.partition(some[live], len(live) - k)[len(live) - k]
                        live = live[some[live] >= (bar - 1e-9 * (1 + abs(bar)) if np.isfinite(bar) else bar)]
                    exact = (x[live] * q[i]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                    best = np.lexsort((x_id[live], -exact))[:k]
                    ids.append(np.full(len(best), q_id[i]))
                    near.append(x_id[live[best]])
                    score.append(exact[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        return pa.table({"query_id": join(ids, pa.int64()), "vec_id": join(near, pa.int64()), "score": join(score, pa.float64())})

    return run


def nearest_neighbours(
    vectors: DataFrame, every: int, k: int, tables: int = 4, hashes: int = 6, width: float = 1.6,
    probes: int = 200, part_rows: int = 16384, query_rows: int = 16384, seed: int = 7, exact_rows: int = 1024,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found among visited buckets.

    Queries are the rows whose id is divisible by ``every``; candidates all rows with another id and as many
    components. Rows are split into bands of like norms. Every row lies in one bucket of each table of its band, or
    in a single bucket if its band has at most ``exact_rows`` rows. In each band a query visits ``probes`` buckets of
    each table, its own and those around it, in the order of their estimated success; what it finds in any table is
    ranked by the exact inner product in double precision, ties to the smaller id. Queries that find fewer than ``k``
    rows although there are more are compared with all rows. ``usable`` says which rows take part. Buckets of more
    than ``part_rows`` rows are split, and a query visits all their parts. Parts of about ``part_rows`` rows meet
    blocks of about ``query_rows`` queries, whatever the tables' sizes.
    """
    table = materialise(usable(vectors, nonzero=True).withColumn("dim", F.size("x")), "vectors")
    most = F.array_max(F.transform("x", lambda v: F.abs(v)))
    shares = F.aggregate(F.transform("x", lambda v: v / F.col("most")), F.lit(0.0), lambda s, v: s + v * v)
    placed = table.withColumn("most", most).withColumn("norm", F.log("most") + F.log(shares) / 2).drop("most")
    wanted = F.col("vec_id") % every == 0
    top = placed.agg(F.max("norm")).first()[0] or 0.0
    step = F.floor((F.lit(top) - F.col("norm")) / float(np.log(BAND_RATIO)) + 1e-9)
    banded = placed.withColumn("band", step.cast("int"))
    bands: dict[int, dict[int, float | None]] = {}
    size: dict[int, int] = {}
    asking = 0
    for r in banded.groupBy("dim", "band").agg(F.count("*").alias("n"), F.count_if(wanted).alias("m"), F.max("norm").alias("norm")).collect():
        bands.setdefault(r["dim"], {})[r["band"]] = None if r["n"] <= exact_rows else r["norm"]
        size[r["dim"]], asking = size.get(r["dim"], 0) + r["n"], asking + r["m"]
    make = lambda dim: _Tables(dim, tables, hashes, width, seed)
    kind = "vec_id long, dim int, table int, bucket long"
    rows = banded.drop("norm").mapInArrow(_hash_rows(make, bands, 0), kind)
    asked = table.where(wanted)
    visits = banded.drop("norm").where(wanted).mapInArrow(_hash_rows(make, bands, probes), kind).distinct()
    count = sum(size.values())
    found = materialise(_search(table, rows, asked, visits, count, asking, k, part_rows, query_rows), "found")

    have = found.groupBy("query_id").agg(F.count("*").alias("have"))
    due = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for d, n in size.items() for v in (d, min(k, n - 1))]), F.col("dim")), F.lit(0)) if size else F.lit(0)
    short = asked.join(have, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("have", F.lit(0)) < due)
    short = materialise(short.select("vec_id", "x", "dim"), "short-queries")
    few = short.count()
    if not few:
        return found
    alone = lambda df: df.select("vec_id", "dim", F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"))
    dims = short.select("dim").distinct()
    full = _search(table, alone(table.join(dims, "dim", "left_semi")), short, alone(short), count, few, k, part_rows, query_rows)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(full)


def _search(
    table: DataFrame, rows: DataFrame, asked: DataFrame, visits: DataFrame, n: int, m: int, k: int, part_rows: int, query_rows: int,
) -> DataFrame:
    """The ``k`` best of the ``rows`` whose buckets the ``visits`` name, for ``m`` queries ``asked`` of ``n`` rows."""
    parts, blocks = max(1, -(-n // part_rows)), max(1, -(-m // query_rows))
    where = ["dim", "table", "bucket"]
    splits = materialise(rows.groupBy(*where).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("splits")), "buckets")
    part = F.pmod(F.xxhash64("bucket", "split"), F.lit(parts)).cast("int")
    placed = rows.join(splits, where).withColumn("split", F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int"))
    placed = placed.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = placed.join(table.select("vec_id", "x"), "vec_id").select("dim", "table", "part", "block", "bucket", "vec_id", "x")
    spread = visits.join(splits, where).withColumn("split", F.explode(F.expr("sequence(0, splits - 1)")))
    right = spread.withColumn("part", part).groupBy("dim", "table", "part", "vec_id").agg(
        F.collect_set("bucket").alias("buckets")
    ).withColumn("block", deal(F.col("vec_id"), blocks)).join(asked.select("vec_id", "x"), "vec_id").select(
        "dim", "table", "part", "block", "vec_id", "buckets", "x"
    )
    keys = ["dim", "table", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rerank(k), SCHEMA)
    return nearest(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)

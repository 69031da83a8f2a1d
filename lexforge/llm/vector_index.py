"""Balanced posting lists over unit vectors, the index of problems 5 and 6.

Centroids come from balanced hierarchical clustering of a bounded, documented sample
(SAMPLE rows). A neighbour graph over the centroids, held in memory, answers which
list a vector is nearest to. Every different vector is stored once, in that list.

The search is exact (:meth:`Index.reach`): a query meets every list that by the triangle
inequality of angles can hold a vector as near as it asks for. The tasks read the stored
rows from the shared folder, block after block, beside the queries they hold, so no vector
is copied or shuffled for a search and the disk in use grows in proportion to the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, join_hot, keep, pick, schema, spread, stream, type_of, width, written

SAMPLE, LEAF, DEGREE = 40_000, 64, 16
#: Queries that a task holds at a time, and how many neighbouring rows of the table go to the same task.
WIDE_BLOCK, PIECE = 16_384, 256
#: Rows read and queries multiplied with them at a time (products that stay in the cache), and by how much a cosine in single precision may be off.
CHUNK, STEP, ROUNDING = 2048, 512, 2e-6


def clean_vectors(df: DataFrame, id_col: str = "doc_id", vec_col: str = "vec", version_col: str = "built_at", dim: int = 64) -> DataFrame:
    """(id, v): the latest clean vector of each id, scaled to length 1, as the bytes of its doubles.

    Clean is a vector of ``dim`` finite numbers that are not all 0. Of equal versions the greater bytes win; null ids are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(v=[r.tobytes() for r in matrix(pdf["v"])])

    rows = latest(df, id_col, vec_col, version_col, dim)
    return rows.mapInPandas(run, rows.schema)


def latest(df: DataFrame, id_col: str, vec_col: str, version_col: str, dim: int) -> DataFrame:
    """As :func:`clean_vectors`, but ``v`` is the vector as it came, packed (:func:`pack`)."""
    rows = pick(df, id=id_col, vec=vec_col, version=version_col).where(F.col("id").isNotNull() & (F.size("vec") == dim))
    fields = schema(("id", type_of(df, id_col)), ("v", "binary"), ("version", type_of(df, version_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(pc.fill_null(pc.list_flatten(b["vec"]).cast(pa.float64()), float("nan"))).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            part = b.filter(pa.array(ok))
            yield pa.record_batch([part["id"], pa.array(pack(x[ok]), pa.binary()), part["version"]], names=["id", "v", "version"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of an id are neighbours, the last id of a batch may go on in the next
        held: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            first = np.flatnonzero((pdf["id"] != pdf["id"].shift()).to_numpy())
            size = np.diff(np.append(first, len(pdf)))
            for j in np.flatnonzero(size > 1):
                units = [r.tobytes() for r in matrix(pdf["v"].iloc[first[j] : first[j] + size[j]])]
                first[j] += units.index(max(units))
            yield pdf.iloc[first[:-1]]
            held = pdf.iloc[first[-1:]]
        if held is not None:
            yield held

    good = spread(rows, 2).mapInArrow(run, fields).repartition(width(df.sparkSession, 2), "id")
    top = good.withColumn("r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("version")))).where("r = 1").select("id", "v")
    return top.mapInPandas(choose, top.schema)


#: Kinds of packed rows: decimals of 2 bytes with so many places, floats of 4 bytes, doubles.
PLACES, SINGLE, DOUBLE = range(7), 100, 101


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of doubles as bytes, nothing lost but the sign of a zero: as short decimals or single floats where these give the same doubles, else as doubles."""
    kind, out = np.full(len(x), DOUBLE), [b""] * len(x)

    def put(at: np.ndarray, code: int, rows: np.ndarray) -> None:
        kind[at] = code
        for i, r in zip(at, rows):
            out[i] = bytes([code]) + r.tobytes()

    left = np.arange(len(x))
    for code in [*PLACES, SINGLE]:
        part = x[left]
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.rint(part * 10.0**code) if code != SINGLE else part.astype("f4")
        same = y / 10.0**code == part if code != SINGLE else y.astype("f8") == part
        ok = same.all(1) & ((np.abs(y) < 2**15).all(1) | (code == SINGLE))
        put(left[ok], code, y[ok].astype("<i2" if code != SINGLE else "<f4"))
        left = left[~ok]
    put(left, DOUBLE, x[left].astype("<f8"))
    return out


def matrix(col) -> np.ndarray:
    """The packed vectors, each scaled to length 1."""
    rows = list(col)
    kinds = np.fromiter((r[0] for r in rows), "u1", len(rows))
    out = np.zeros((len(rows), 0))
    for code in np.unique(kinds):
        at = np.flatnonzero(kinds == code)
        raw = np.frombuffer(b"".join(rows if len(at) == len(rows) else [rows[i] for i in at]), "u1").reshape(len(at), -1)[:, 1:]
        x = np.ascontiguousarray(raw).view({SINGLE: "<f4", DOUBLE: "<f8"}.get(code, "<i2")).astype("f8")
        x = x / 10.0**code if code < SINGLE else x
        if not out.shape[1]:
            out = np.empty((len(rows), x.shape[1]))
        x = x / np.abs(x).max(1)[:, None]
        out[at] = x / np.linalg.norm(x, axis=1)[:, None]
    return out + 0.0  # no negative zeros


def balanced_leaves(x: np.ndarray, leaf: int = LEAF, fan: int = 8, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of a balanced tree over unit vectors: large nodes are split by k-means with a penalty on crowded children."""
    rng, out, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        part = x[at]
        k = min(fan, math.ceil(len(at) / leaf))
        if k > 1:
            cent = part[rng.choice(len(at), k, replace=False)]
            load = np.ones(k)
            for _ in range(rounds):
                own = (part @ cent.T - 0.05 * (load - 1)).argmax(1)
                size = np.bincount(own, minlength=k)
                load = size * k / len(at)
                cent = np.stack([part[own == j].sum(0) if size[j] else part[rng.integers(len(at))] for j in range(k)])
                cent /= np.maximum(np.linalg.norm(cent, axis=1), 1e-12)[:, None]
            if (size > 0).sum() > 1:
                todo += [at[own == j] for j in range(k) if size[j]]
                continue
        c = part.sum(0)
        out.append(c / max(np.linalg.norm(c), 1e-12))
    return np.stack(out)


@dataclass
class Graph:
    """Centroids with their neighbour graph."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE, entries: int = 32) -> Graph:
        n = len(centroids)
        degree = min(degree, n)
        links = np.empty((n, degree), "i4")
        for lo in range(0, n, 1024):
            s = centroids[lo : lo + 1024] @ centroids.T
            links[lo : lo + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        return cls(centroids, links, np.unique(np.linspace(0, n - 1, min(entries, n)).astype(int)))

    def nearest(self, q: np.ndarray, beam: int = 32, expand: int = 6, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, cosines) of about the ``beam`` nearest centroids of each query, best first: best-first search along the graph."""
        n, c = len(q), len(self.centroids)
        beam = min(beam, c)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, c), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        sims = q @ self.centroids[self.entries].T
        done = np.zeros(ids.shape, bool)
        for _ in range(rounds):
            order = np.argsort(-sims, axis=1)[:, :beam]
            ids, sims, done = ids[rows, order], sims[rows, order], done[rows, order]
            # the first few of the beam that have not been followed yet
            open_ = ~done & (np.cumsum(~done, axis=1) <= expand) & np.isfinite(sims)
            if not open_.any():
                break
            r, col = np.nonzero(open_)
            done[r, col] = True
            who, to = np.repeat(r, self.links.shape[1]), self.links[ids[r, col]].reshape(-1)
            fresh = ~seen[who, to]
            pair = np.unique(who[fresh].astype("i8") * c + to[fresh])
            who, to = pair // c, pair % c
            seen[who, to] = True
            if not len(who):
                continue
            s = np.einsum("ij,ij->i", q[who], self.centroids[to])
            count = np.bincount(who, minlength=n)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more_sims = np.zeros((n, count.max()), "i8"), np.full((n, count.max()), -np.inf)
            more_ids[who, place], more_sims[who, place] = to, s
            ids, sims = np.concatenate([ids, more_ids], 1), np.concatenate([sims, more_sims], 1)
            done = np.concatenate([done, np.zeros(more_ids.shape, bool)], 1)
        order = np.argsort(-sims, axis=1)[:, :beam]
        return ids[rows, order], sims[rows, order]


@dataclass
class Block:
    """Rows of the table with their columns, unit vectors in both precisions, lists and places in the table."""

    rows: pa.RecordBatch
    x: np.ndarray
    x4: np.ndarray
    home: np.ndarray
    place: np.ndarray
    floor: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pa.RecordBatch, place: np.ndarray) -> Block:
        x = matrix(rows["v"].to_pylist())
        return cls(rows, x, x.astype("f4"), np.asarray(rows["home"]), place)

    def __len__(self) -> int:
        return len(self.place)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.rows[name].to_numpy(zero_copy_only=False)


#: (places of queries, stored block, their cosines in single precision), queries without a cosine near their floor left out
Pairs = Iterator[tuple[np.ndarray, Block, np.ndarray]]


def exact(q: Block, r: np.ndarray, x: Block, c: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision; within ROUNDING of a bound they decide."""
    return np.einsum("ij,ij->i", q.x[r], x.x[c])


class Index:
    """An index over packed (id, v). ``members`` (id, key): equal vectors have one key. ``classes`` has one row for each different
    vector: id (the smallest), key, v, copies, home (its list); ``folder`` is where that table stands, sorted by list."""

    def __init__(self, vectors: DataFrame) -> None:
        self.spark = vectors.sparkSession
        self.key = type_of(vectors, "id")
        keyed = self.keyed(vectors)
        folder = written(keyed)
        given = self.spark.read.schema(keyed.schema).parquet(folder)
        del vectors, keyed
        drop(self.spark)
        self.members = keep(given.select("id", "key"))
        self.count = given.count()
        share = min(1.0, SAMPLE / max(1, self.count))
        picked = given.select("v").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * SAMPLE).toPandas()["v"]
        self.graph = None
        if self.count:
            x = np.unique(matrix(picked), axis=0) if len(picked) else matrix(given.select("v").limit(1).toPandas()["v"])
            self.graph = self.spark.sparkContext.broadcast(Graph.build(balanced_leaves(x)))
        raw = self.merged(given).repartition(width(self.spark, 2), "key").groupBy("key").agg(F.min(F.struct("id", "v")).alias("r"), F.sum("copies").alias("copies"))
        routed = self.route(raw.select("r.id", "key", "r.v", "copies"))
        if self.graph:  # neighbouring lists stand together
            n, parts = len(self.graph.value.centroids), width(self.spark, 2)
            routed = routed.repartition(parts, (F.col("home") * parts / n).cast("int")).sortWithinPartitions("home")
        self.folder = written(routed)
        self.classes = self.spark.read.schema(routed.schema).parquet(self.folder)
        #: Of each list the cosine of its farthest row to the centre, and its rows.
        self.far = {r["home"]: (r["c"], r["n"]) for r in self.classes.groupBy("home").agg(F.min("home_cos").alias("c"), F.count("*").alias("n")).collect()}
        del given, raw, routed
        drop(self.spark, folder)

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        """``rows`` (id, v, key) with copies; of equal keys in a batch the smallest id only, so a hot vector is sent once for each batch."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf.sort_values("id", ignore_index=True)
                yield pdf.assign(copies=pdf.groupby("key")["id"].transform("size").astype("i8")).drop_duplicates("key")

        return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("copies", T.LongType())]))

    @staticmethod
    def keyed(rows: DataFrame) -> DataFrame:
        """``rows`` with key, a digest of the unit vector."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(key=[hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in matrix(pdf["v"])])

        return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())]))

    def route(self, rows: DataFrame) -> DataFrame:
        """``rows`` (v, ...) with the list each is stored in (home) and the cosine to its centre."""
        graph = self.graph

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    ids, sims = graph.value.nearest(matrix(part["v"]), beam=12)
                    yield part.assign(home=ids[:, 0].astype("i4"), home_cos=sims[:, 0])

        fields = T.StructType([*rows.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("home_cos", T.DoubleType())])
        return rows.mapInPandas(run, fields) if graph else self.spark.createDataFrame([], fields)

    def reach(self, folder: str, floor: Callable[[Block, Block], np.ndarray], work: Callable[[Block, Pairs], pa.RecordBatch], fields: T.StructType) -> DataFrame:
        """Apply ``work`` to every row of the table in ``folder`` and all its cosines to other rows that may reach its floor.

        ``floor`` gives the first floors of queries from the block of neighbouring rows they stand in; ``work`` may raise them
        (``q.floor``) as it goes on. A list is left out only if no vector as far from its centre as its farthest one can reach the floor.
        Each task holds up to WIDE_BLOCK queries, dealt in pieces of PIECE rows, and reads the table in blocks of CHUNK.
        """
        graph = self.graph
        far = self.far
        if not graph:
            return self.spark.createDataFrame([], fields)
        radius = np.full(len(graph.value.centroids), np.pi)
        for home, (c, _) in far.items():
            if abs(np.linalg.norm(graph.value.centroids[home]) - 1) < 1e-6:
                radius[home] = np.arccos(np.clip(c, -1, 1))
        cos_r, sin_r = np.cos(radius), np.sin(radius)
        total = sum(n for _, n in far.values())
        tasks = max(2 * self.spark.sparkContext.defaultParallelism, math.ceil(total / WIDE_BLOCK))

        def reaches(q: Block, at: slice, lists: np.ndarray) -> np.ndarray:
            # a list is open if angle(query, centre) <= angle of the floor + radius; cosines are compared, sums beyond half a turn reach all
            f = np.clip(q.floor[at], -1, 1)[:, None]
            least = f * cos_r[lists] - np.sqrt(1 - f * f) * sin_r[lists]
            return ((q.x[at] @ graph.value.centroids[lists].T >= least - 1e-6) | (f <= -cos_r[lists])).any(1)

        def blocks() -> Iterator[Block]:
            at = 0
            for rows in stream(folder, CHUNK):
                yield Block.of(rows, np.arange(at, at + len(rows)))
                at += len(rows)

        def queries(task: int) -> Iterator[Block]:
            got, floors, held = [], [], 0

            def joined() -> Block:
                rows = pa.Table.from_batches([b.rows for b in got]).combine_chunks().to_batches()[0]
                q = Block.of(rows, np.concatenate([b.place for b in got]))
                q.floor = np.concatenate(floors)
                return q

            for b in blocks():
                for lo in range(0, len(b), PIECE):
                    if b.place[lo] // PIECE % tasks != task:
                        continue
                    piece = Block(b.rows[lo : lo + PIECE], *(y[lo : lo + PIECE] for y in (b.x, b.x4, b.home, b.place)))
                    got.append(piece)
                    floors.append(floor(piece, b))
                    held += len(piece)
                if held + CHUNK > WIDE_BLOCK:
                    yield joined()
                    got, floors, held = [], [], 0
            if got:
                yield joined()

        def pairs(q: Block) -> Pairs:
            for b in blocks():
                lists = np.unique(b.home)
                who = np.flatnonzero(np.concatenate([reaches(q, slice(lo, lo + CHUNK), lists) for lo in range(0, len(q), CHUNK)]))
                for lo in range(0, len(who), STEP):
                    r = who[lo : lo + STEP]
                    s = q.x4[r] @ b.x4.T
                    own = np.flatnonzero((q.place[r] >= b.place[0]) & (q.place[r] <= b.place[-1]))
                    s[own, q.place[r[own]] - b.place[0]] = -2  # a row is no neighbour of itself
                    some = np.flatnonzero(s.max(1) >= (q.floor[r] - ROUNDING).astype("f4"))
                    if len(some):
                        yield r[some], b, s[some]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for task in b["id"].to_pylist():
                    for q in queries(task):
                        yield work(q, pairs(q))

        return self.spark.range(0, tasks, 1, tasks).mapInArrow(run, fields)


def nearest_classes(index: Index, k: int, min_cos: float) -> DataFrame:
    """(id, cos, other): of each class the ``k`` nearest other classes with cosine of at least ``min_cos``, of equal cosines the smaller ids."""

    def floor(q: Block, around: Block) -> np.ndarray:
        # the k-th best among the neighbouring rows, itself aside, is no better than the k-th best of all
        if len(around) <= k:
            return np.full(len(q), float(min_cos)) - 1e-12
        s = q.x @ around.x.T
        s[np.arange(len(q)), q.place - around.place[0]] = -2
        return np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], min_cos) - 1e-12

    def nearer(q: Block, pairs: Pairs) -> pa.RecordBatch:
        ids = q["id"]
        # the best so far: places of queries, ids and cosines, k a query at most
        row, other, cos = np.zeros(0, "i8"), ids[:0], np.zeros(0)
        for who, b, s in pairs:
            hit = s >= (q.floor[who, None] - ROUNDING).astype("f4")
            many = np.flatnonzero(hit.sum(1) > k)
            if len(many):  # no more than the k-th and its ties
                take = s.shape[1] - k
                hit[many] &= s[many] >= np.partition(s[many], take, axis=1)[:, take, None] - np.float32(2 * ROUNDING)
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            r = who[r]
            e = exact(q, r, b, c)
            ok = e >= q.floor[r]
            r, c, e = r[ok], c[ok], e[ok]
            mine = np.isin(row, r)
            r, o, e = np.concatenate([row[mine], r]), np.concatenate([other[mine], b["id"][c]]), np.concatenate([cos[mine], e])
            order = np.lexsort((np.unique(o, return_inverse=True)[1], -e, r))
            r, o, e = r[order], o[order], e[order]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            size = np.diff(np.append(first, len(r)))
            rank = np.arange(len(r)) - np.repeat(first, size)
            full = rank == k - 1
            q.floor[r[full]] = np.maximum(q.floor[r[full]], e[full])
            r, o, e = r[rank < k], o[rank < k], e[rank < k]
            row, other, cos = np.concatenate([row[~mine], r]), np.concatenate([other[~mine], o]), np.concatenate([cos[~mine], e])
        ids = q.rows["id"].take(pa.array(row))
        return pa.record_batch([ids, pa.array(cos), pa.array(other, ids.type)], names=["id", "cos", "other"])

    return index.reach(index.folder, floor, nearer, schema(("id", index.key), ("cos", "double"), ("other", index.key)))


def first_members(index: Index, k: int) -> DataFrame:
    """(id, first): the ``k`` smallest ids of each class; hot classes are cut by salt before."""
    total = index.classes.agg(F.sum("copies").alias("total_rows"))
    c = join_hot(index.members, index.classes.where("copies > 1").select(F.col("id").alias("rep"), "key", "copies"), "key", "copies", total).select("rep", "id")
    c = c.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("id"))).where(F.col("r") <= k)
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k)
    return c.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("first")).withColumnRenamed("rep", "id")


def similar_vectors(df: DataFrame, k: int = 5, min_cos: float = -1.0, id_col: str = "doc_id", vec_col: str = "vec", version_col: str = "built_at", dim: int = 64) -> DataFrame:
    """(id, other, cos, rank): the ``k`` most similar vectors of each clean vector with cosine of at least ``min_cos``.

    Exact but for the rounding of cosines: lists are left out only where they can hold nothing nearer. Equal vectors are searched once and then expanded; equal cosines
    rank by id. A vector without neighbours has no row; an empty table gives none.
    """
    index = Index(latest(df, id_col, vec_col, version_col, dim))
    # each is read several times below
    near, first = keep(nearest_classes(index, k, min_cos)), keep(first_members(index, k + 1))
    wide = near.join(first.withColumnRenamed("id", "other"), "other", "left").select("id", "cos", F.explode(F.coalesce("first", F.array("other"))).alias("other"))
    own = first.select("id", F.lit(1.0).alias("cos"), F.explode("first").alias("other"))
    cand = wide.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("m"), "other"))).alias("cand"))
    classes = index.classes.select("id", "key", "copies")
    cand = keep(cand.join(classes, "id").select(F.col("id").alias("rep"), "cand", "copies"))
    total = index.classes.agg(F.sum("copies").alias("total_rows"))
    member = keep(join_hot(index.members, classes.select(F.col("id").alias("rep"), "key", "copies"), "key", "copies", total).select("id", "rep"))
    out = join_hot(member, cand, "rep", "copies", total).select("id", F.posexplode(F.slice(F.filter("cand", lambda x: x["other"] != F.col("id")), 1, k)).alias("rank", "n"))
    return out.select("id", F.col("n.other").alias("other"), (-F.col("n.m")).alias("cos"), (F.col("rank") + 1).alias("rank"))

"""The most similar vectors of each vector.

Method: multi-index hashing over learned rotated binary codes. A rotation (iterative quantisation on a bounded sample) and,
per rotated axis, thresholds at the sample's quantiles are learned; a bit tells on which side of a threshold a vector lies,
so a code is known from the number of thresholds below the vector on each axis, and the Hamming distance of two codes is the
number of thresholds between them. A code is split into `PARTS` substrings, of which substring j has every PARTS-th threshold
from the j-th on; each is indexed by its value. Shorter codes use every 2nd, 4th, ... threshold.

Search in three passes over the indexed rows. (1) For each query the longest code is found whose first substring has at least
k + 1 equal rows. (2) Rows that equal the query in any substring at that length are reranked by their floats; their k-th
distance bounds the true one. (3) At the code length at which the ball of that radius crosses fewer than
2 * PARTS thresholds, pigeonhole probing looks up all codes within that Hamming radius: they differ in at most one bit from the
query in some substring. What it returns is reranked by floats. As the rotation keeps distances and the radius is that of the
ball, no neighbour is lost: the result is exact where all axes are kept, and approximate only with fewer axes than dimensions.

Defined results: vectors with a null, NaN or infinite component take no part, nor do queries for them; equal distances are
ordered by id; a vector is never its own neighbour, its exact copies are; of copies only the k + 1 smallest ids are indexed,
since no other can be among the k nearest; with fewer than k other vectors all of them come out; empty inputs give an empty
result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import Stage
from ..tables import finite

PARTS = 4
SAMPLE_ROWS = 50_000  # the rotation and thresholds are learned from about so many rows, taken by a hash of their id
MAX_AXES = 8
PROBE_ROWS = 1_000_000  # lookups up to this many (some 30 MB) go to every task; more are joined by shuffle


@dataclass
class Codes:
    """Learned rotation and thresholds."""

    centre: np.ndarray
    rotation: np.ndarray  # dimensions x axes, with orthonormal columns
    thresholds: np.ndarray  # axes x thresholds

    @classmethod
    def learn(cls, sample: np.ndarray, axes: int, steps: int, rounds: int = 30) -> Codes:
        d = sample.shape[1]
        if not len(sample):
            return cls(np.zeros(d), np.eye(d)[:, :axes], np.zeros((axes, 0)))
        centre = sample.mean(axis=0)
        x = sample - centre
        _, vectors = np.linalg.eigh(x.T @ x)
        main = vectors[:, ::-1][:, :axes]
        v = x @ main
        r, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(axes, axes)))
        for _ in range(rounds):  # the rotation that brings the projections nearest to their signs
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        rotation = main @ r
        grid = (np.arange(steps) + 0.5) / steps
        return cls(centre, rotation, np.quantile(x @ rotation, grid, axis=0).T.copy())

    @property
    def top(self) -> int:
        """The code length index at which no threshold is left."""
        return int(self.thresholds.shape[1]).bit_length()

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.rotation

    def ordinals(self, y: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(t, y[:, a], side="right") for a, t in enumerate(self.thresholds)], axis=1).astype(np.int32)

    def probes(self, y: np.ndarray, radius: float) -> list[tuple[int, int, tuple[int, ...]]]:
        """(code length index, substring, value) to look up for all vectors within `radius` of a projected query."""
        pad = radius * (1 + 1e-9) + 1e-12
        if not np.isfinite(radius):
            return [(self.top, 0, (0,) * len(y))]
        here = np.array([np.searchsorted(t, y[a], side="right") for a, t in enumerate(self.thresholds)])
        low = np.array([np.searchsorted(t, y[a] - pad, side="left") for a, t in enumerate(self.thresholds)])
        high = np.array([np.searchsorted(t, y[a] + pad, side="right") for a, t in enumerate(self.thresholds)])
        level = 0
        while level < self.top:
            s = 1 << level  # thresholds number s, 2s, ... are kept; i < number <= j lie between ordinals i and j
            crossed = int(np.maximum(here // s - low // s, high // s - here // s).sum())
            if crossed < 2 * PARTS:
                break
            level += 1
        else:
            return [(self.top, 0, (0,) * len(y))]
        s, far = 1 << level, crossed // PARTS
        out = []
        for j in range(PARTS):
            at, lo, hi = ((o - j * s) // (s * PARTS) for o in (here, low, high))
            spans = [range(max(a - far, x), min(a + far, z) + 1) for a, x, z in zip(at.tolist(), lo.tolist(), hi.tolist())]
            for value in itertools.product(*spans):
                if sum(abs(v - a) for v, a in zip(value, at.tolist())) <= far:
                    out.append((level, j, value))
        return out


def _value(ordinal: Column, level: int, j: int) -> Column:
    return F.shiftright(ordinal - j * (1 << level), level + PARTS.bit_length() - 1)


def _key(axes: int, level: int, j: int) -> Column:
    return F.xxhash64(F.lit(level), F.lit(j), *[_value(F.col(f"o{a}"), level, j) for a in range(axes)])


def _np_key(level: int, j: int, values: np.ndarray) -> np.ndarray:
    """One number per row of substring values. Different values may share one by chance, which only adds candidates."""
    h = np.full(len(values), level * PARTS + j + 1, np.int64)
    with np.errstate(over="ignore"):
        for a in range(values.shape[1]):
            h = (h ^ values[:, a]) * np.int64(-7046029254386353131)
            h ^= h >> np.int64(31)
    return h


def _np_values(ordinals: np.ndarray, level: int, j: int) -> np.ndarray:
    return (ordinals.astype(np.int64) - (j << level)) >> (level + PARTS.bit_length() - 1)


class Lookups:
    """Keys to be looked up and the queries that ask for each, for a task that holds all of them."""

    def __init__(self, keys: np.ndarray, query: np.ndarray, combos: list[tuple[int, int]]):
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.query, self.combos = query[order], combos

    def found(self, ordinals: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, places of their keys), one pair of arrays per code length and substring."""
        for level, j in self.combos:
            key = _np_key(level, j, _np_values(ordinals, level, j))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rows = np.flatnonzero(self.keys[at] == key)
            yield rows, at[rows]

    def pairs(self, ordinals: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, queries) that share a key."""
        for rows, at in self.found(ordinals):
            n = self.count[at]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(rows, n), self.query[np.repeat(self.first[at], n) + k]


class Best:
    """The k nearest rows of each query so far."""

    def __init__(self, vectors: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int):
        self.vectors, self.own, self.bound, self.k = vectors, own, bound, k
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        self.n = 0

    def add(self, query: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        square = np.zeros(len(query))
        for a in range(x.shape[1]):
            d = x[:, a] - self.vectors[query, a]
            square = square + d * d
        distance = np.sqrt(square)
        ok = (ids != self.own[query]) & (distance <= self.bound[query])
        if ok.any():
            self.held.append((query[ok], distance[ok], ids[ok]))
            self.n += int(ok.sum())
            if self.n > 500_000 + 2 * self.k * len(self.own):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, i = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        q, d, i = q[fresh], d[fresh], i[fresh]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        q, d, i = q[keep], d[keep], i[keep]
        full = rank[keep] == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], d[full])
        self.held, self.n = [(q, d, i)], len(q)
        return q, d, i


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query q; a pair found in several substrings counts once."""
    order = Window.partitionBy("q").orderBy("distance", "id")
    return pairs.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).distinct()


def most_similar(
    vectors: DataFrame, id_col: str, columns: list[str], k: int = 10, queries: DataFrame | None = None, axes: int | None = None, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(probe_id, id, distance, rank). queries: (probe_id, id) for ids of the collection; without it every vector is one. A
    query given twice, or an id that occurs twice, is answered as often."""
    spark, d = vectors.sparkSession, len(columns)
    axes = min(axes or min(d, MAX_AXES), d)
    stage = Stage(spark, "neighbours")
    names = [f"v{i}" for i in range(d)]
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    valid = F.col("id").isNotNull()
    for n in names:
        valid = valid & finite(F.col(n))
    rows, n_rows = stage.write_counted(rows.filter(valid))
    share = max(1, n_rows // max(sample_rows, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(share)) == 0).select(*names).limit(2 * sample_rows)
    steps = 1 << max(3, min(12, round(np.log2(3.0 * max(n_rows, 1) ** (1 / 3)))))
    codes = Codes.learn(sample.toPandas().to_numpy(float).reshape(-1, d), axes, steps)
    top = codes.top

    own = Window.partitionBy(*names).orderBy("id")
    few = rows.withColumn("copy", F.row_number().over(own)).filter(F.col("copy") <= k + 1).drop("copy")
    ordinals = [f"o{a}" for a in range(axes)]
    shared = spark.sparkContext.broadcast(codes)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            o = c.ordinals(c.project(b[names].to_numpy(float)))
            for a in range(axes):
                b[f"o{a}"] = o[:, a]
            yield b

    plain = few.schema
    with_codes = T.StructType(plain.fields + [T.StructField(o, T.IntegerType()) for o in ordinals])
    indexed = stage.write(few.mapInPandas(index, with_codes))

    asked = queries if queries is not None else rows.select(F.col("id").alias("probe_id"), "id")
    asked = asked.select("probe_id", F.col("id").alias("own_id")).filter("probe_id is not null and own_id is not null")
    probe_rows = asked.join(rows, F.col("own_id") == F.col("id")).drop("id").mapInPandas(
        index, T.StructType([asked.schema["probe_id"], asked.schema["own_id"]] + [f for f in plain.fields if f.name in names] + [T.StructField(o, T.IntegerType()) for o in ordinals])
    )
    # q names a query, whatever its probe_id
    probes, n_probes = stage.write_counted(probe_rows.withColumn("q", F.monotonically_increasing_id()))
    as_query = [F.col(n).alias(f"p{n}") for n in names]

    def met(lookups: DataFrame, n: int, combos: list[tuple[int, int]]) -> DataFrame:
        keys = F.explode(F.array(*[_key(axes, lv, j) for lv, j in combos])).alias("key")
        side = indexed.select("id", *names, keys)
        # a shuffled join splits its hot keys by itself: it is followed by another shuffle on q
        found = side.join(F.broadcast(lookups) if n <= PROBE_ROWS else lookups, "key")
        square = None
        for c in names:
            part = (F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}"))
            square = part if square is None else square + part
        return found.filter(F.col("id") != F.col("own_id")).select("q", "id", F.sqrt(square).alias("distance"))

    def named(nearest: DataFrame) -> DataFrame:
        return nearest.join(probes.select("q", "probe_id"), "q").select("probe_id", "id", "distance", "rank")

    if n_probes * (top + 1) * PARTS <= PROBE_ROWS:
        return named(_by_tasks(stage, indexed, probes, codes, shared, names, axes, k))

    # (1) how many rows equal each query in the first substring, by code length
    levels = range(top + 1)
    wanted = probes.select("q", F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), _key(axes, lv, 0).alias("key")) for lv in levels])).alias("w")).select("q", "w.level", "w.key")
    keys, n_keys = stage.write_counted(wanted.select("key").distinct())
    all_keys = indexed.select(F.explode(F.array(*[_key(axes, lv, 0) for lv in levels])).alias("key"))
    counts = all_keys.join(F.broadcast(keys) if n_keys <= PROBE_ROWS else keys, "key").groupBy("key").agg(F.count("*").alias("n"))
    level = wanted.join(counts, "key").filter((F.col("n") > k) | (F.col("level") == top)).groupBy("q").agg(F.min("level").alias("level"))

    # (2) a bound on the k-th distance
    chosen = stage.write(probes.join(level, "q"))
    used = sorted(r[0] for r in chosen.select("level").distinct().collect())
    if not used:
        return named(_nearest(probes.select("q", "own_id").join(rows, F.lit(False)).select("q", "id", F.lit(0.0).alias("distance")), k))
    by_level = F.lit(None).cast("array<bigint>")
    for lv in used:
        by_level = F.when(F.col("level") == lv, F.array(*[_key(axes, lv, j) for j in range(PARTS)])).otherwise(by_level)
    first = chosen.select("q", "own_id", *as_query, F.explode(by_level).alias("key"))
    near = _nearest(met(first, n_probes * PARTS, [(lv, j) for lv in used for j in range(PARTS)]), k)
    bound = near.groupBy("q").agg(F.when(F.countDistinct("id") >= k, F.max("distance")).alias("radius"))

    # (3) pigeonhole probing of that radius
    fields = [T.StructField("q", T.LongType()), probes.schema["own_id"]] + [T.StructField(f"p{n}", T.DoubleType()) for n in names]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            y = c.project(b[[f"p{n}" for n in names]].to_numpy(float))
            r = b["radius"].fillna(np.inf).to_numpy(float)
            hits = [c.probes(y[i], r[i]) for i in range(len(b))]
            out = b.drop(columns="radius").loc[b.index.repeat([len(h) for h in hits])].reset_index(drop=True)
            flat = [x for h in hits for x in h]
            out["level"] = np.array([x[0] for x in flat], np.int32)
            out["part"] = np.array([x[1] for x in flat], np.int32)
            for a in range(axes):
                out[f"c{a}"] = np.array([x[2][a] for x in flat], np.int32)
            yield out

    ints = [T.StructField(n, T.IntegerType()) for n in ["level", "part"] + [f"c{a}" for a in range(axes)]]
    asked_for = probes.join(bound, "q", "left").select("q", "own_id", *as_query, "radius").mapInPandas(probe, T.StructType(fields + ints))
    asked_for = asked_for.select("q", "own_id", *[f"p{n}" for n in names], "level", "part", F.xxhash64("level", "part", *[f"c{a}" for a in range(axes)]).alias("key"))
    lookups, n_lookups = stage.write_counted(asked_for)
    combos = sorted((r[0], r[1]) for r in lookups.select("level", "part").distinct().collect())
    return named(_nearest(met(lookups.drop("level", "part"), n_lookups, combos), k))


def _by_tasks(stage: Stage, indexed: DataFrame, probes: DataFrame, codes: Codes, shared, names: list[str], axes: int, k: int) -> DataFrame:
    """(q, id, distance, rank) of queries few enough for their lookups to go to every task. A task goes over its rows of the
    index once per pass, holds no more than the k nearest so far of each query, and hands on these."""
    spark, top = indexed.sparkSession, codes.top
    asked = probes.toPandas()  # at most PROBE_ROWS / PARTS rows
    ordinal = [f"o{a}" for a in range(axes)]
    vectors, own, o = asked[names].to_numpy(float), asked["own_id"].to_numpy(), asked[ordinal].to_numpy(np.int64)
    each = np.arange(len(asked))

    def gather(lookups: Lookups, bound: np.ndarray) -> pd.DataFrame | DataFrame:
        sent = spark.sparkContext.broadcast((lookups, vectors, own, bound))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            some, v, mine, most = sent.value
            best = Best(v, mine, most.copy(), k)
            for b in batches:
                x, ids = b[names].to_numpy(float), b["id"].to_numpy()
                for rows, query in some.pairs(b[ordinal].to_numpy()):
                    for lo in range(0, len(rows), 1_000_000):
                        r = rows[lo : lo + 1_000_000]
                        best.add(query[lo : lo + 1_000_000], ids[r], x[r])
            q, d, i = best.cut()
            yield pd.DataFrame({"at": q, "id": i, "distance": d})

        return indexed.mapInPandas(run, T.StructType([T.StructField("at", T.LongType()), indexed.schema["id"], T.StructField("distance", T.DoubleType())]))

    def numbered(found: DataFrame) -> DataFrame:
        names_of = spark.createDataFrame(pd.DataFrame({"at": each, "q": asked["q"].to_numpy(np.int64)}), "at long, q long")
        return _nearest(found.join(F.broadcast(names_of), "at").drop("at"), k)

    if not len(asked):
        return _nearest(probes.select("q", F.col("own_id").alias("id"), F.lit(0.0).alias("distance")), k)
    # (1) how many rows equal each query in the first substring, by code length
    levels = range(top + 1)
    keys = np.stack([_np_key(lv, 0, _np_values(o, lv, 0)) for lv in levels])
    first = Lookups(keys.ravel(), np.tile(each, len(keys)), [(lv, 0) for lv in levels])
    sent = spark.sparkContext.broadcast(first)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(sent.value.keys), np.int64)
        for b in batches:
            for _, at in sent.value.found(b[ordinal].to_numpy()):
                n += np.bincount(at, minlength=len(n))
        yield pd.DataFrame({"at": np.flatnonzero(n), "n": n[n > 0]})

    counted = indexed.select(*ordinal).mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(first.keys), np.int64)
    n[counted["at"].to_numpy()] = counted["n"].to_numpy()
    enough = n[np.searchsorted(first.keys, keys)] > k
    enough[top] = True
    level = enough.argmax(axis=0)
    # (2) a bound on the k-th distance
    used = [(int(lv), j) for lv in np.unique(level) for j in range(PARTS)]
    at_level = [(np.flatnonzero(level == lv), lv, j) for lv, j in used]
    keys = np.concatenate([_np_key(lv, j, _np_values(o[rows], lv, j)) for rows, lv, j in at_level])
    near = gather(Lookups(keys, np.concatenate([rows for rows, _, _ in at_level]), used), np.full(len(asked), np.inf))
    near = near.groupBy("at").agg(F.slice(F.array_sort(F.array_distinct(F.array_agg(F.struct("distance", "id")))), 1, k).alias("n"))
    radii = near.filter(F.size("n") >= k).select("at", F.get("n", F.lit(k - 1))["distance"].alias("r")).toPandas()
    radius = np.full(len(asked), np.inf)
    radius[radii["at"].to_numpy()] = radii["r"].to_numpy()
    # (3) pigeonhole probing of that radius
    spread = spark.createDataFrame(pd.DataFrame({"at": each, "radius": radius}).join(pd.DataFrame(vectors, columns=names)), "at long, radius double, " + ", ".join(f"{c} double" for c in names))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            hits = [c.probes(y, r) for y, r in zip(c.project(b[names].to_numpy(float)), b["radius"])]
            flat = [x for h in hits for x in h]
            keys = [int(_np_key(lv, j, np.array([value]))[0]) for lv, j, value in flat]
            yield pd.DataFrame({"at": b["at"].repeat([len(h) for h in hits]).to_numpy(), "level": [x[0] for x in flat], "part": [x[1] for x in flat], "key": keys})

    looked = spread.repartition(spark.sparkContext.defaultParallelism, "at").mapInPandas(probe, "at long, level int, part int, key long").toPandas()
    combos = sorted(set(zip(looked["level"].tolist(), looked["part"].tolist())))
    found = gather(Lookups(looked["key"].to_numpy(), looked["at"].to_numpy(), combos), radius)
    return numbered(stage.write(found))


def detection_vectors(detections: DataFrame) -> DataFrame:
    """(intid, x, y, z, t) of the valid vectors of detections, with the epoch scaled to their range."""
    x, y, z = (F.col(f"rho_{c}") for c in "xyz")
    norm = F.sqrt(x * x + y * y + z * z)
    return detections.filter(finite(x) & finite(y) & finite(z)).filter(F.abs(norm - 1.0) <= 1e-6).select(
        "intid", x.alias("x"), y.alias("y"), z.alias("z"), (F.lit(0.01) * (F.col("epoch") - 2460000.5)).alias("t")
    )

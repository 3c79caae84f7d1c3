"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Unit vectors are dealt to coarse centroids; what is left of a vector beyond its centroid is
brought to length 1, cut into sub-vectors, and each is replaced by the nearest of 256
codewords, so vectors close together are coded as finely, for their distances, as vectors
far apart. Centroids and codebooks are fitted on a bounded sample (``sample`` vectors chosen
by a hash); every vector is indexed. A query looks into the lists of some centroids only,
in order of the product with their centroid plus what their vectors' remainders add at
``spread`` deviations; how many is measured against brute force within the sample.

Codes decide what is compared, and lose nothing: with each entry goes the length of what
its code leaves, which with the query's part across the centroid bounds the error of the
coded product. Every entry of the probed lists whose bound reaches the ``k``-th best is
compared exactly, in double precision on the original vectors.

Equal vectors are one index entry with the smallest ids that a result can use, so that
many copies can't crowd out what lies near them. Lists are packed into shelves of at most
about ``block`` entries, near lists together, long lists cut, and queries into blocks of
``block`` too, so no task holds a list. Of n shelves a query first looks into the root of n
that its best lists are in; the ``k``-th score found there is the bar that results of all
other shelves must reach, so rows found for a query grow with the root of n and not with n.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take
no part, nor do those of another dimension than the sample's most common one; queries
with fewer candidates than asked for get all of them; ties go to the smaller id; rows with
a null id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.plans.workspace import materialize
from foliomill.plans.workspace import spread as spread_out

CODEWORDS = 256


def usable(vector: str = "embedding") -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's iterations; empty cells are moved to random points."""
    rng = np.random.default_rng(seed)
    if len(points) <= k:
        return np.concatenate([points, points[rng.integers(0, len(points), k - len(points))]]) if len(points) < k else points.copy()
    centers = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest(points, centers)
        sums, counts = np.zeros_like(centers), np.bincount(cell, minlength=k)
        np.add.at(sums, cell, points)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        centers[~full] = points[rng.integers(0, len(points), int((~full).sum()))]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center; points go in blocks, so the matrix of distances stays small."""
    half, step = (centers**2).sum(1) / 2, max(1, (1 << 22) // len(centers))
    return np.concatenate([np.zeros(0, np.int64), *[(points[i : i + step] @ centers.T - half).argmax(1) for i in range(0, len(points), step)]])


@dataclass
class ProductQuantiser:
    """Coarse centroids and one codebook per sub-vector, for unit vectors of ``width`` components."""

    centers: np.ndarray
    books: np.ndarray
    width: int
    part: int
    rest: np.ndarray  # per list: mean length of its residuals

    @classmethod
    def fit(cls, vectors: np.ndarray, lists: int, part: int = 4) -> ProductQuantiser:
        width = vectors.shape[1]
        padded = _padded(_unit(vectors), part)
        centers = k_means(padded, max(1, min(lists, len(padded))))
        cell = nearest(padded, centers)
        rest = padded - centers[cell]
        lengths = np.sqrt(np.bincount(cell, (rest**2).sum(1), len(centers)) / np.maximum(np.bincount(cell, minlength=len(centers)), 1))
        books = np.stack([k_means(rest[:, i : i + part], CODEWORDS, 8, seed=i) for i in range(0, padded.shape[1], part)])
        return cls(centers.astype(np.float32), books.astype(np.float32), width, part, lengths.astype(np.float32))


@dataclass
class ScaledQuantiser:
    """Coarse centroids and codebooks for remainders of length 1, all in double precision so that vectors close together stay apart."""

    centers: np.ndarray
    books: np.ndarray
    rest: np.ndarray  # per list: mean length of its remainders
    part: int

    @classmethod
    def fit(cls, units: np.ndarray, lists: int, part: int = 4) -> ScaledQuantiser:
        centers = k_means(units, max(1, min(lists, len(units))))
        centers = centers[np.argsort(nearest(centers, k_means(centers, math.isqrt(len(centers)))), kind="stable")]
        cell = nearest(units, centers)
        directions, lengths = _directions(units - centers[cell])
        rest = np.sqrt(np.bincount(cell, lengths**2, len(centers)) / np.maximum(np.bincount(cell, minlength=len(centers)), 1))
        directions = directions[lengths > 0] if (lengths > 0).any() else directions
        books = np.stack([k_means(directions[:, i : i + part].astype(np.float32), CODEWORDS, 8, seed=i) for i in range(0, units.shape[1], part)])
        return cls(centers, books.astype(np.float64), rest, part)

    @property
    def squares(self) -> np.ndarray:
        return np.maximum((self.centers**2).sum(1), 1e-30)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, ...]:
        """(list, codes, length of the remainder, product of centroid and what the code leaves, length of that across the centroid) of each vector."""
        cell = nearest(units, self.centers)
        directions, lengths = _directions(units - self.centers[cell])
        codes = np.stack([nearest(directions[:, i * self.part : (i + 1) * self.part], book) for i, book in enumerate(self.books)], 1).astype(np.uint8)
        left = units - self.decode(cell, codes, lengths)
        along = (self.centers[cell] * left).sum(1)
        across = np.sqrt(np.maximum((left**2).sum(1) - along**2 / self.squares[cell], 0))
        return cell, codes, lengths, along, across

    def decode(self, cell: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.centers[cell] + lengths[:, None] * np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)

    def split(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(products with all centroids, lengths of the queries' parts across them)."""
        products = queries @ self.centers.T
        return products, np.sqrt(np.maximum(1 - products**2 / self.squares, 0))

    def probes(self, queries: np.ndarray, spread: float) -> np.ndarray:
        """All lists for each query, the most promising first."""
        products, across = self.split(queries)
        return np.argsort(-(products + spread * across * self.rest / np.sqrt(queries.shape[1])), axis=1, kind="stable")

    def lists_needed(self, units: np.ndarray, k: int, spread: float, want: float, asked: int = 256) -> int:
        """How many lists hold the share ``want`` of the ``k`` nearest of ``asked`` of these vectors, found by brute force among them."""
        if len(units) < 2:
            return 1
        queries = units[np.random.default_rng(1).permutation(len(units))[:asked]]
        near = np.argsort(-(queries @ units.T), axis=1, kind="stable")[:, 1 : k + 1]
        place = np.argsort(self.probes(queries, spread), axis=1)
        return int(np.quantile(np.take_along_axis(place, nearest(units, self.centers)[near], 1), want, method="higher")) + 1


def _directions(rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(remainders at length 1, their lengths)."""
    lengths = np.sqrt((rests**2).sum(1))
    return rests / np.where(lengths > 0, lengths, 1)[:, None], lengths


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, by a power of two so that the largest component is between 1/2 and 1: no square overflows and no digit changes."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def _folded(products: np.ndarray) -> np.ndarray:
    """Row sums from left to right, as a fold over an array adds."""
    return products.cumsum(1)[:, -1]


def _cosines(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Cosines with the vectors at some places, digit for digit as ``operators.vectors.cosine`` has them."""
    return _folded(vectors[places] * query) / (math.sqrt(_folded(query[None] ** 2)[0]) * norms[places])


def _units(scaled: np.ndarray, part: int) -> np.ndarray:
    return _padded(scaled / np.sqrt((scaled**2).sum(1, keepdims=True)), part)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v**2).sum(1, keepdims=True))).astype(np.float32)


def _padded(vectors: np.ndarray, part: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % part)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(chunk), -1) if len(chunk) else np.zeros((0, 0))


def shelves_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shelf, number of shelves) of each list: lists share a shelf up to ``block`` entries, longer ones have several."""
    first, parts, at, held = [], [], 0, 0
    for size in sizes.tolist():
        if held and held + size > block:
            at, held = at + 1, 0
        n = max(1, math.ceil(size / block))
        first.append(at)
        parts.append(n)
        at, held = (at, held + size) if n == 1 else (at + n, 0)
    return np.array(first), np.array(parts)


def ann_search(vectors: DataFrame, queries: DataFrame, k: int = 5, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` nearest to each query by cosine.

    A row is no candidate for a query with its own id. ``settings`` go to ``found_by_shelf``.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found_by_shelf(vectors, queries, k, **settings)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_by_shelf(vectors: DataFrame, queries: DataFrame, k: int = 5, probe: float = 0.3, least_probed: int = 512, sample: int = 20_000, block: int = 8192, spread: float = 2.0, want: float = 0.97, part: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score): the nearest of each shelf that a query looks into, the ``k`` nearest of all among them.

    ``probe`` is the least share of lists a query looks into. It looks into more until they
    hold ``least_probed`` entries, and where the share ``want`` of the nearest in the sample
    takes more.
    """
    spark, usable_row = vectors.sparkSession, usable(vector) & F.col(key).isNotNull()
    kind = vectors.schema[vector].dataType.simpleString()
    same = Window.partitionBy("v").orderBy("id")
    few = vectors.where(usable_row).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    entries = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    drawn = entries.orderBy(F.xxhash64("v")).limit(sample).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    widths = [len(r.v) for r in drawn]
    width = max(sorted(set(widths)), key=widths.count)
    entries = entries.where(F.size("v") == width)
    count = entries.count()
    units = _units(_scaled(np.array([r.v for r in drawn if len(r.v) == width])), part)
    # lists are nearer to what they are fitted on than to the rest, so with vectors beyond the sample a part of it is kept to measure
    kept = len(units) // 4 if count > len(units) else 0
    quantiser = ScaledQuantiser.fit(units[kept:], int(min(16 * math.sqrt(count), count / 4, sample / 4)) or 1, part)
    lists = len(quantiser.centers)
    at_least = max(1, math.ceil(probe * lists), quantiser.lists_needed(units[:kept] if kept > k else units, k, spread, want))
    shipped = spark.sparkContext.broadcast(quantiser)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                cell, codes, *numbers = shipped.value.encode(_units(_scaled(_matrix(batch.column("v"))), part))
                found = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays([*found, batch.column("ids"), batch.column("v")], names=["list", "code", "length", "along", "across", "ids", "v"])

    indexed = materialize(entries.select("ids", "v").mapInArrow(index, f"list int, code binary, length double, along double, across double, ids array<long>, v {kind}"), "ann-index")
    held = dict(indexed.groupBy("list").count().collect())  # one row per list, of which there are at most sample / 4
    sizes = np.array([held.get(i, 0) for i in range(lists)])
    even = math.ceil(count / math.ceil(count / block))
    first, parts = shelves_of(sizes, even + min(int(sizes.max()), even // 8))

    early = max(1, math.isqrt(int((first + parts).max())))

    def deal(later: bool) -> DataFrame:
        """Each query with the lists that it looks into, by shelf: the ``early`` shelves that its best lists are in, or all others."""

        def dealt(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    asked = batch.slice(at, 256)
                    order = shipped.value.probes(_units(_scaled(_matrix(asked.column(1))), part), spread)
                    reached = np.cumsum(sizes[order], 1) >= min(least_probed, count)
                    rows, where, looked = [], [], []
                    for n, lists_in_order in enumerate(order):
                        chosen = lists_in_order[: max(at_least, int(reached[n].argmax()) + 1)]
                        chosen = chosen[sizes[chosen] > 0]
                        cut = parts[chosen]
                        shelf = np.repeat(first[chosen] - np.cumsum(cut) + cut, cut) + np.arange(cut.sum())
                        _, seen, which = np.unique(shelf, return_index=True, return_inverse=True)
                        wanted = (np.argsort(np.argsort(seen))[which] >= early) == later
                        shelf, chosen = shelf[wanted], np.repeat(chosen, cut)[wanted]
                        by_shelf = np.argsort(shelf, kind="stable")
                        found, starts = np.unique(shelf[by_shelf], return_index=True)
                        rows += [n] * len(found)
                        where += found.tolist()
                        looked += np.split(chosen[by_shelf], starts[1:]) if len(found) else []
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), asked.column(0).take(take), asked.column(1).take(take), pa.array(looked, pa.list_(pa.int32()))], names=["shelf", "query_id", "q", "lists"])

        return asked.mapInArrow(dealt, f"shelf int, query_id long, q {kind}, lists array<int>")

    def by_codes(shelf: pa.Table, asking: pa.Table) -> pa.Table:
        """The ``k`` best rows of a shelf for each query that reach its bar."""
        rows: list[tuple[int, int, float]] = []
        if shelf.num_rows and asking.num_rows:
            quantiser, in_list = shipped.value, shelf["list"].to_numpy()
            codes = np.frombuffer(b"".join(shelf["code"].to_pylist()), np.uint8).reshape(shelf.num_rows, -1)
            along, across = shelf["along"].to_numpy(), shelf["across"].to_numpy()
            coded = quantiser.decode(in_list, codes, shelf["length"].to_numpy())
            v, ids = _scaled(_matrix(shelf["v"])), shelf["ids"].to_pylist()
            norms = np.sqrt(_folded(v * v))
            least, lone = np.array([x[0] for x in ids]), np.array([len(x) == 1 for x in ids])
            after = np.array([x[:2][-1] for x in ids])
            for at in range(0, asking.num_rows, 64):
                some = asking.slice(at, 64)
                scaled = _scaled(_matrix(some["q"]))
                units = _units(scaled, part)
                products, beyond = quantiser.split(units)
                near = units @ coded.T
                for n, (query, looked, bar) in enumerate(zip(some["query_id"].to_pylist(), some["lists"].to_pylist(), some["bar"].to_pylist())):
                    probed = np.zeros(len(quantiser.centers), bool)
                    probed[looked] = True
                    here = np.flatnonzero(probed[in_list] & ~(lone & (least == query)))
                    cell, q, bar = in_list[here], scaled[n], -math.inf if bar is None else bar
                    estimate = near[n, here] + products[n, cell] / quantiser.squares[cell] * along[here]
                    reach = estimate + beyond[n, cell] * across[here] + 1e-9
                    if len(here) > k:
                        best = _cosines(q, v, norms, here[np.argpartition(-estimate, k)[:k]])
                        here = here[reach >= max(bar, best.min())]
                    score = _cosines(q, v, norms, here)
                    here, score = here[score >= bar], score[score >= bar]
                    chosen = np.lexsort((np.where(least[here] == query, after[here], least[here]), -score))[:k]
                    found = [(-float(score[x]), i) for x in chosen for i in ids[here[x]] if i != query]
                    rows += [(query, i, -s) for s, i in sorted(found)[:k]]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    asked = queries.where(usable_row & (F.size(vector) == width)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast(kind).alias("q")).distinct()
    asked = spread_out(materialize(asked, "ann-queries"))
    asked_parts = max(1, math.ceil(asked.count() / block))
    shelf_table = spark.createDataFrame(list(zip(range(lists), first.tolist(), parts.tolist())), "list int, first int, parts int")
    shelved = indexed.join(F.broadcast(shelf_table), "list").withColumn("shelf", F.col("first") + F.pmod(F.hash(F.col("ids")[0]), F.col("parts"))).drop("first", "parts")
    shelved = shelved.withColumn("asked_part", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))
    groups = ["shelf", "asked_part"]

    def look(asking: DataFrame) -> DataFrame:
        asking = asking.withColumn("asked_part", F.pmod(F.hash("query_id"), F.lit(asked_parts)))
        return shelved.groupBy(*groups).cogroup(asking.groupBy(*groups)).applyInArrow(by_codes, "query_id long, vec_id long, score double")

    found = look(deal(later=False).withColumn("bar", F.lit(None).cast("double")))
    if int((first + parts).max()) > early:
        found = materialize(found, "ann-first")
        bars = found.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("bar"))  # of k rows a shelf
        found = found.union(look(deal(later=True).join(bars, "query_id", "left").select("shelf", "query_id", "q", "lists", "bar")))
    return found

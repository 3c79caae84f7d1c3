"""Near-duplicate vectors: inverted lists with product-quantised residuals, probed as far as a link can reach.

Vectors are compared inside one domain (label and width), as unit vectors. Equal vectors of
a domain are one class with a count of its copies. Two vectors with cosine >= t are at most
r = sqrt(2 - 2 t) apart, and three bounds follow from that, none of which can lose a link:

* A query looks into the list of a centroid c only if the plane half-way between c and the
  query's own centroid is at most r away, since all vectors of that list lie beyond it.
* An entry is the sum of its centroid, one codeword for each sub-vector of its residual,
  and a rest of known length. The distance from a query to the coded point is looked up in the
  query's tables (sub-vectors against codewords); entries whose coded point is farther than r
  plus the length of their rest are out.
* What is left is compared exactly, in double precision on the original vectors.

Entries stand in shelves of about ``block``: a domain's lists, in a fixed order, are cut
into as many runs as its size asks for, and a run that is longer still is cut by hash. A
query is sent to the shelves that hold a list that it looks into. Tasks see one
shelf and a block of queries; they put out a count of links for each query and of the links
only a spanning forest, so that a group of copies never becomes a list of pairs.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component, and
rows with a null label, link with nothing and are components of one; so are rows with a null
id, whose component is null; vectors of different widths don't link; rows with one id are
one node, linked by that, and each counts its own links to other rows; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.ann import ProductQuantiser, usable
from foliomill.llm.arrow_text import let_go
from foliomill.operators.graph import connected_components
from foliomill.plans.workspace import materialize

#: what single precision may add to a distance
SLACK = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; very large and very small ones too."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors cut or filled with zeros to ``width`` components; distances don't grow by that."""
    return np.pad(vectors[:, :width], ((0, 0), (0, max(0, width - vectors.shape[1]))))


class ReachingIndex:
    """A product quantiser that knows which lists and entries a link of length ``reach`` can lead to."""

    def __init__(self, quantiser: ProductQuantiser, reach: float) -> None:
        self.quantiser, self.reach = quantiser, reach
        centers = quantiser.centers.astype(np.float64)
        self.centers, self.half = centers, (centers**2).sum(1) / 2
        # lists in an order in which neighbours are near each other: along the widest direction of the centroids
        _, _, axes = np.linalg.svd(centers - centers.mean(0), full_matrices=False)
        self.place = np.empty(len(centers), np.int64)
        self.place[np.argsort(centers @ axes[0], kind="stable")] = np.arange(len(centers))
        self.shared = np.zeros(len(centers))  # share of the sample in lists before this one

    def weigh(self, sample: np.ndarray) -> None:
        counts = np.bincount(self.place[self.own(sample)], minlength=len(self.centers)) + 1.0
        before = np.concatenate([[0], np.cumsum(counts)[:-1]]) / counts.sum()
        self.shared = before[self.place]

    def own(self, points: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[(points[i : i + 4096] @ self.centers.T - self.half).argmax(1) for i in range(0, len(points), 4096)]])

    def run_of(self, lists: np.ndarray | None, runs: np.ndarray | int) -> np.ndarray:
        """In which of ``runs`` runs of lists a list stands."""
        shared = self.shared if lists is None else self.shared[lists]
        return np.minimum((shared * runs).astype(np.int64), runs - 1)

    def probed(self, points: np.ndarray) -> np.ndarray:
        """(points, lists): whether a vector at most ``reach`` away can be in the list."""
        near = points @ self.centers.T - self.half
        own = near.argmax(1)
        apart = np.sqrt(np.maximum(2 * (self.half[own][:, None] + self.half[None, :] - self.centers[own] @ self.centers.T), 0))
        return near.max(1, keepdims=True) - near <= (self.reach + SLACK) * apart + 1e-9

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coded point's square and rest's length) of each point."""
        own, q = self.own(points), self.quantiser
        rest, coded = points - self.centers[own], self.centers[own].copy()
        codes = np.empty((len(points), len(q.books)), np.uint8)
        for m, book in enumerate(q.books.astype(np.float64)):
            part = slice(m * q.part, (m + 1) * q.part)
            codes[:, m] = (rest[:, part] @ book.T - (book**2).sum(1) / 2).argmax(1)
            coded[:, part] += book[codes[:, m]]
        return own, codes, np.stack([(coded**2).sum(1), np.sqrt(((points - coded) ** 2).sum(1))], 1)

    def tables(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(products with the centroids: (lists, points); with all codewords of each sub-vector: (parts, codewords, points))."""
        q = self.quantiser
        split = points.astype(np.float32).reshape(len(points), len(q.books), q.part)
        return (self.centers @ points.T).astype(np.float32), np.einsum("mkd,qmd->mkq", q.books, split)


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one width as rows of doubles."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1) if len(chunk) else np.zeros((0, 1))


def candidates(index: ReachingIndex, points: np.ndarray, looked: np.ndarray, lists: np.ndarray, codes: np.ndarray, known: np.ndarray):
    """Pairs (query, entry) in arrays, a few queries at a time: those that tables and rests leave over."""
    order = np.argsort(lists, kind="stable")
    starts = np.flatnonzero(np.diff(lists[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    limit, square = (index.reach + SLACK + known[:, 1]) ** 2 - known[:, 0] + SLACK, (points**2).sum(1)
    for at in range(0, len(points), 512):
        coarse, tables = index.tables(points[at : at + 512])
        asks = looked[at : at + 512]
        for low, high in zip(starts, ends):
            here = order[low:high]
            center = lists[here[0]]
            asking = np.flatnonzero(asks[:, center])
            if not len(asking):
                continue
            near = np.repeat(coarse[center, asking][None, :], len(here), 0)
            for m in range(len(tables)):
                near += tables[m][codes[here, m]][:, asking]
            entry, query = np.nonzero(-2 * near <= limit[here][:, None] - square[at + asking])
            if len(entry):
                yield at + asking[query], here[entry]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, sample: int = 20_000, block: int = 8192, part: int = 4, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row of ``vectors``: key, n_links, component_id, kept.

    Rows of equal, non-null label are linked where their cosine is at least ``threshold``;
    a component's id is the smallest key in it. Centroids and codewords are fitted on at most
    ``sample`` vectors; all are indexed.
    """
    spark = vectors.sparkSession
    fine = usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()
    # two 64-bit hashes stand for a vector where only equality counts, so that vectors travel once
    same = [F.xxhash64(label, vector).alias("h1"), F.xxhash64(F.lit(7), vector, label).alias("h2")]
    rows = materialize(vectors.select(F.col(key), F.when(fine, same[0]).alias("h1"), F.when(fine, same[1]).alias("h2")), "vectors-rows")
    nothing = [F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept")]
    usable_rows = vectors.where(fine).select(F.col(label).alias("domain"), F.size(vector).alias("width"), F.col(vector).alias("v"), F.col(key).alias("id"), *same)
    classes = usable_rows.groupBy("domain", "width", "v", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("entry"), "*"), "vectors-classes")
    drawn = classes.orderBy(F.xxhash64("v"), "entry").limit(sample).select("v", "width").collect()
    if not drawn:
        return rows.select(key, *nothing)
    widths = [r.width for r in drawn]
    width = math.ceil(max(sorted(set(widths)), key=widths.count) / part) * part
    points = np.concatenate([fitted(unit(np.array([r.v], np.float64)), width) for r in drawn])
    points = points[np.abs(points).max(1) > 0]
    # lists as for a single domain of middling size: a query that looks into all of a small one gains nothing from more
    domains = materialize(classes.groupBy("domain", "width").agg(F.count(F.lit(1)).alias("n")), "vectors-domains")
    largest = domains.agg(F.max("n")).first()[0]
    index = ReachingIndex(ProductQuantiser.fit(points, int(max(1, min(4 * math.sqrt(largest), len(points) / 8))), part), math.sqrt(2 - 2 * threshold))
    index.weigh(points)
    shipped = spark.sparkContext.broadcast(index)
    runs = F.ceil(F.col("n") / block).cast("int").alias("runs")
    placed = classes.join(domains.select("domain", "width", runs), ["domain", "width"])
    kind = vectors.schema[vector].dataType.simpleString()
    label_kind = vectors.schema[label].dataType.simpleString()

    def encode(batches):
        let_go()
        for batch in batches:
            index, size = shipped.value, batch.num_rows
            lists, codes, known, run = np.zeros(size, np.int64), [b""] * size, np.zeros((size, 2)), np.zeros(size, np.int64)
            for rows, found in by_width(batch.column(3)):
                own, bits, rests = index.encode(fitted(unit(found), width))
                lists[rows], known[rows], run[rows] = own, rests, index.run_of(own, batch.column(4).to_numpy()[rows])
                for r, c in zip(rows, bits):
                    codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(run, pa.int32()), pa.array(lists, pa.int32()), pa.array(codes, pa.binary()), pa.array(known[:, 0]), pa.array(known[:, 1])], names=["domain", "width", "entry", "v", "runs", "copies", "run", "list", "code", "square", "rest"])

    shape = f"domain {label_kind}, width int, entry long, v {kind}, runs int, copies long, run int, list int, code binary, square double, rest double"
    indexed = materialize(placed.select("domain", "width", "entry", "v", "runs", "copies").mapInArrow(encode, shape), "vectors-index")
    shelf = ["domain", "width", "run"]
    shelves = indexed.groupBy(*shelf).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    shelves = materialize(shelves, "vectors-shelves")
    cut = lambda n: F.pmod(F.xxhash64("entry"), n).cast("int")
    left = indexed.join(shelves, shelf).withColumn("cut", cut(F.col("cuts")))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).select(*shelf, "cut", "part", "entry", "v", "copies", "list", "code", "square", "rest")

    def deal(batches):
        for batch in batches:
            index = shipped.value
            take, run, bits = [], [], []
            for rows, found in by_width(batch.column(3)):
                runs = batch.column(4).to_numpy()
                looked = index.probed(fitted(unit(found), width))
                for r, mask in zip(rows, looked):
                    where = index.run_of(None, int(runs[r]))
                    for x in np.unique(where[mask]):
                        take.append(r)
                        run.append(x)
                        bits.append(np.packbits(mask & (where == x)).tobytes())
            chosen = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(chosen.column(i) for i in range(5)), pa.array(run, pa.int32()), pa.array(bits, pa.binary())], names=["domain", "width", "entry", "v", "runs", "run", "looked"])

    asked = indexed.select("domain", "width", "entry", "v", "runs").mapInArrow(deal, f"domain {label_kind}, width int, entry long, v {kind}, runs int, run int, looked binary")
    # a domain's queries are dealt to as many parts as it has runs, so that no part has much more than a shelf
    right = asked.join(shelves, shelf).withColumn("part", F.pmod(F.xxhash64("entry", F.lit(3)), F.col("runs")).cast("int"))
    right = right.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    right = right.select(*[F.col(c).alias(f"of_{c}") for c in (*shelf, "cut", "part")], F.col("entry").alias("query"), F.col("v").alias("q"), "looked")

    def compare(entries: pa.Table, queries: pa.Table) -> pa.Table:
        src, dst, counted, counts = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if entries.num_rows and queries.num_rows:
            index = shipped.value
            v, q = unit(matrix_of(entries["v"])), unit(matrix_of(queries["q"]))
            ids, counted = entries["entry"].to_numpy(), queries["query"].to_numpy()
            copies, counts = entries["copies"].to_numpy(), np.zeros(len(counted), np.int64)
            codes = np.frombuffer(b"".join(entries["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            looked = np.unpackbits(np.frombuffer(b"".join(queries["looked"].to_pylist()), np.uint8).reshape(len(counted), -1), axis=1).astype(bool)
            known = np.stack([entries["square"].to_numpy(), entries["rest"].to_numpy()], 1)
            forest = Forest(np.concatenate([ids, counted]))
            for asking, held in candidates(index, fitted(q, width), looked, entries["list"].to_numpy(), codes, known):
                other = counted[asking] != ids[held]
                asking, held = asking[other], held[other]
                # exactly, a bounded number of pairs at a time
                for at in range(0, len(asking), 1 << 14):
                    a, b = asking[at : at + (1 << 14)], held[at : at + (1 << 14)]
                    near = np.einsum("ij,ij->i", q[a], v[b]) >= threshold
                    np.add.at(counts, a[near], copies[b[near]])
                    forest.join(counted[a[near]], ids[b[near]])
            src, dst = forest.links()
        keep = counts > 0
        n, rows = len(src), int(keep.sum())
        return pa.table({
            "query": pa.array([*counted[keep].tolist(), *src], pa.int64()), "links": pa.array([*counts[keep].tolist(), *[None] * n], pa.int64()), "other": pa.array([*[None] * rows, *dst], pa.int64()),
        })

    found = left.groupBy(*shelf, "cut", "part").cogroup(right.groupBy(*[f"of_{c}" for c in (*shelf, "cut", "part")])).applyInArrow(compare, "query long, links long, other long")
    found = materialize(found, "vectors-found")
    counts = found.where("links is not null").groupBy(F.col("query").alias("entry")).agg(F.sum("links").alias("links"))
    ends = found.where("other is not null").select(F.least("query", "other").alias("src"), F.greatest("query", "other").alias("dst")).distinct()
    named = classes.select("entry", "rep")
    by_rep = ends.join(named.select(F.col("entry").alias("src"), F.col("rep").alias("a")), "src").join(named.select(F.col("entry").alias("dst"), F.col("rep").alias("b")), "dst").select("a", "b")
    reps = materialize(classes.select("h1", "h2", "entry", "rep", "copies").join(counts, "entry", "left"), "vectors-reps").drop("entry")
    of_class = rows.where("h1 is not null").join(reps, ["h1", "h2"])
    # rows that share an id are one node
    several = of_class.groupBy(key).agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high").drop("high")
    twice = of_class.select(key, F.col("rep").alias("b")).join(several, key).select("a", "b").distinct()
    components = connected_components(by_rep.unionByName(twice), "a", "b").withColumnRenamed("node", "rep")
    settled = reps.join(components, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.join(materialize(settled, "vectors-settled"), ["h1", "h2"], "left")
    component = F.coalesce("component", key)
    return out.select(key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))


def by_width(column: pa.Array, kind: type = np.float64):
    """(rows, their vectors) of a list column, for each width in it."""
    sizes = np.diff(column.offsets.to_numpy())
    begins, flat = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py(), column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[begins[rows][:, None] + np.arange(size)]


class Forest:
    """Keeps the links that join what was apart; of all others nothing."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes = np.unique(nodes)
        self.root = np.arange(len(self.nodes))
        self.kept: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        while len(a):
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            # one link for each root that is the larger end of some: they can't close a circle, as every root points to a smaller one
            low, high = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
            heads, first = np.unique(high, return_index=True)
            self.kept += zip(a[first].tolist(), b[first].tolist())
            parent = np.arange(len(self.root))
            parent[heads] = low[first]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.root = parent[self.root]

    def links(self) -> tuple[list[int], list[int]]:
        pairs = np.array(self.kept, np.int64).reshape(-1, 2)
        return self.nodes[pairs[:, 0]].tolist(), self.nodes[pairs[:, 1]].tolist()

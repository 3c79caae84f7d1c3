"""Hard negatives by rotated one-bit codes with deterministic intervals round their estimates.

A vector's components become integers floor(256 x). Each integer vector is turned by a fixed
random rotation; the signs of the turned vector are its code, and the code's alignment with
the vector (the mean of the turned components' sizes) is stored beside it. What the code
leaves, about 0.6 of the length, is turned and coded likewise, ``LEVELS`` times in all, and
the length of the last rest is stored. An anchor's turned vector is cut into ``PLANES`` bit planes, so that its product
with a code is a sum of popcounts of AND-ed words; with the alignments, these products give
an estimate of the inner product. By Cauchy and Schwarz it is off by no more than the product of
anchor length and rest length, plus what cutting into planes has cost: an interval that holds the
true score for certain.

First each anchor's positives are found among the rows of its label: rows whose interval ends
below the k-th highest lower end are out. Then, for each positive, rows of other
labels are out whose interval misses the window of wanted scores, or ends below the k-th highest
lower end of those that lie within the window for certain. Surviving intervals are scored in
integers. Anchors and rows meet in blocks, so that no task grows; each block puts out its
best few for each anchor, and of these the best few stand.

Edge cases: rows with a null label, a null vector, a null or non-finite component, and rows with
a null id take no part; an anchor without positives, or whose positive has a score of less
than 0 (an empty window), gives no rows; vectors of different widths don't meet; empty vectors
score 0; rows that share an id stand for themselves, a repeated anchor is mined for each of its
rows; components beyond 64 bits are cut to that range, and scores beyond it count as its nearest
end; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.arrow_text import let_go
from foliomill.llm.vector_dups import by_width
from foliomill.plans.workspace import materialize

LEVELS, PLANES = 5, 7
LONGEST = (1 << 63) - 1


@lru_cache(maxsize=64)
def rotation(width: int, level: int) -> np.ndarray:
    """The rotation of all vectors of a width at a level: from a fixed seed, the same in every task."""
    turned, upper = np.linalg.qr(np.random.default_rng([20240417, width, level]).normal(size=(width, width)))
    return turned * np.sign(np.diag(upper))


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words, the last filled with zeros."""
    padded = np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64)))
    return np.packbits(padded, axis=1).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: (rows, levels, words), alignments: (rows, levels), length of the last rest) of integer vectors."""
    rest = vectors.astype(np.float64)
    codes, alignments = [], []
    for level in range(LEVELS):
        rest = rest @ rotation(vectors.shape[1], level)
        up = rest >= 0
        size = np.abs(rest).mean(1) if rest.shape[1] else np.zeros(len(rest))
        codes.append(_words(up))
        alignments.append(size)
        rest = rest - np.where(up, size[:, None], -size[:, None])
    return np.stack(codes, 1), np.stack(alignments, 1), np.sqrt((rest**2).sum(1))


class Anchors:
    """Anchor vectors as bit planes, for interval estimates against coded rows."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.width = vectors.shape[1]
        turned = vectors.astype(np.float64)
        self.length = np.sqrt((turned**2).sum(1))
        self.levels = []
        for level in range(LEVELS):
            turned = turned @ rotation(self.width, level)
            low, high = (turned.min(1), turned.max(1)) if self.width else (np.zeros(len(turned)), np.zeros(len(turned)))
            step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-300)
            units = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            lost = np.abs(turned - low[:, None] - units * step[:, None]).sum(1)
            self.levels.append((low, step, units.sum(1), lost, [_words((units >> j & 1).astype(bool)) for j in range(PLANES)]))

    def intervals(self, codes: np.ndarray, alignments: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower ends, upper ends) of the inner products: (anchors, rows)."""
        estimate = np.zeros((len(self.length), len(codes)))
        off = self.length[:, None] * rests + 1e-6
        for level, (low, step, units, lost, planes) in enumerate(self.levels):
            code = codes[:, level]
            total = np.zeros(estimate.shape, np.int32)
            for j, plane in enumerate(planes):
                for w in range(code.shape[1]):
                    total += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int32) << j
            ones = np.bitwise_count(code).sum(1, dtype=np.int64)
            signed = low[:, None] * (2 * ones - self.width)[None, :] + step[:, None] * (2 * total - units[:, None])
            estimate += signed * alignments[:, level]
            off += (lost[:, None] + 1e-9 * self.width * self.length[:, None]) * alignments[:, level]
        return np.maximum(estimate - off, -LONGEST), np.minimum(estimate + off, LONGEST)


def products(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in integers, by Python's own where 64 bits could be too few."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = lambda x: max(abs(int(x.max())), abs(int(x.min())))
    if most(anchor) * most(rows) * rows.shape[1] <= LONGEST:
        return rows @ anchor
    return np.array([max(-LONGEST, min(LONGEST, x)) for x in (rows.astype(object) * anchor.astype(object)).sum(1)], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:most]


def kth_highest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def survivors(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Rows that may be among the ``most`` highest of those allowed."""
    return allowed & (high >= kth_highest(low[allowed], most))


def window_survivors(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, floor: int, ceiling: int, most: int) -> np.ndarray:
    """Rows that may be among the ``most`` highest with a score from ``floor`` to ``ceiling``."""
    within = allowed & (low >= floor) & (high <= ceiling)
    return allowed & (high >= floor) & (low <= ceiling) & (high >= kth_highest(low[within], most))


def integers(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def taking_part(key: str, vector: str, label: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        codes, alignments, rests = [b""] * batch.num_rows, np.zeros((batch.num_rows, LEVELS)), np.zeros(batch.num_rows)
        for rows, vectors in by_width(batch.column(4), np.int64):
            found, alignments[rows], rests[rows] = encode(vectors)
            for r, code in zip(rows, found):
                codes[r] = code.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(list(alignments), pa.list_(pa.float64())), pa.array(rests)], names=[*batch.schema.names, "code", "alignments", "rest"])


def _block(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(row, id, vectors, codes, alignments, rests) of a block of one width."""
    size = table.num_rows
    matrix = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
    codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(size, LEVELS, -1)
    return table["row"].to_numpy(), table["id"].to_numpy(), matrix("x"), codes, matrix("alignments"), table["rest"].to_numpy()


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), block: int = 8192, anchor_block: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` tells which rows of ``vectors`` are anchors. Negatives of a positive are the
    highest scored rows of other labels between ``share`` hundredths of the positive's score.
    """
    low_share, high_share = share
    fine = vectors.where(taking_part(key, vector, label))
    rows = fine.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), integers(vector).alias("x"), F.size(vector).alias("width"))
    rows = materialize(rows, "negatives-rows")
    label_kind = rows.schema["label"].dataType.simpleString()
    shape = f"row long, id long, label {label_kind}, anchor boolean, x array<long>, width int, code binary, alignments array<double>, rest double"
    coded = materialize(rows.mapInArrow(_coded, shape), "negatives-codes")

    def cells(of: list[str], asking: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows and anchors dealt to a grid of blocks within equal ``of``."""
        counts = coded.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.ceil(F.count_if("anchor") / anchor_block).cast("int").alias("anchor_parts"))
        counts = materialize(counts.where("anchor_parts > 0"), "negatives-blocks")
        part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        left = coded.drop("anchor").join(counts, of).withColumn("part", part("parts")).withColumn("anchor_part", F.explode(F.sequence(F.lit(0), F.col("anchor_parts") - 1))).drop("parts", "anchor_parts")
        right = asking.join(counts, of).withColumn("anchor_part", part("anchor_parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "anchor_parts")
        return left, right.select(*[F.col(c).alias(f"of_{c}") for c in right.columns])

    def meet(of: list[str], asking: DataFrame, func, schema: str) -> DataFrame:
        left, right = cells(of, asking)
        keys = [*of, "part", "anchor_part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*[f"of_{c}" for c in keys])).applyInArrow(func, schema)

    def intervals(held: pa.Table, asking: pa.Table):
        """For each anchor: (its place in ``asking``, its vector, lower ends, upper ends)."""
        row, ids, x, codes, alignments, rests = _block(held)
        at_once = max(1, (1 << 20) // max(1, len(row)))
        wanted = asking["of_x"].combine_chunks()
        matrix = wanted.flatten().to_numpy(zero_copy_only=False).reshape(asking.num_rows, -1)
        for at in range(0, asking.num_rows, at_once):
            lows, highs = Anchors(matrix[at : at + at_once]).intervals(codes, alignments, rests)
            for n in range(len(lows)):
                yield at + n, matrix[at + n], lows[n], highs[n]

    longs = lambda columns: pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})

    def find_positives(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "row", "id", "score")}
        if held.num_rows and asking.num_rows:
            row, ids, x = _block(held)[:3]
            anchor = asking["of_row"].to_numpy()
            for n, vector, low, high in intervals(held, asking):
                left = np.flatnonzero(survivors(low, high, row != anchor[n], positives))
                scores = products(vector, x[left])
                first = best(scores, ids[left], positives)
                out["anchor"] += [anchor[n]] * len(first)
                out["row"] += row[left[first]].tolist()
                out["id"] += ids[left[first]].tolist()
                out["score"] += scores[first].tolist()
        return longs(out)

    asking = coded.where("anchor").select("row", "id", "label", "x", "width")
    found = meet(["width", "label"], asking, find_positives, "anchor long, row long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row"))
    few = found.withColumn("place", place).where(F.col("place") <= positives).groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("positive"), "score"))).alias("positives"))
    asking = materialize(asking.join(few, "row"), "negatives-positives")

    def find_negatives(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")}
        if held.num_rows and asking.num_rows:
            row, ids, x = _block(held)[:3]
            codes_of = {v: n for n, v in enumerate(set(held["label"].to_pylist()))}
            labels = np.array([codes_of[v] for v in held["label"].to_pylist()])
            anchor, anchor_ids, own = asking["of_row"].to_pylist(), asking["of_id"].to_pylist(), asking["of_label"].to_pylist()
            wanted = asking["of_positives"].to_pylist()
            for n, vector, low, high in intervals(held, asking):
                other = labels != codes_of.get(own[n], -1)
                windows = [(p, -(-low_share * p["score"] // 100), high_share * p["score"] // 100) for p in wanted[n]]
                left = [window_survivors(low, high, other, a, z, negatives) for _, a, z in windows]
                every = np.flatnonzero(np.logical_or.reduce(left)) if left else np.zeros(0, np.int64)
                scores = products(vector, x[every])
                for p, a, z in windows:
                    here = np.flatnonzero((scores >= a) & (scores <= z))
                    first = here[best(scores[here], ids[every[here]], negatives)]
                    k = len(first)
                    for c, v in (("anchor", anchor[n]), ("anchor_id", anchor_ids[n]), ("place", p["place"]), ("positive_id", p["positive"]), ("positive_score", p["score"])):
                        out[c] += [v] * k
                    out["negative_id"] += ids[every[first]].tolist()
                    out["negative_score"] += scores[first].tolist()
        return longs(out)

    found = meet(["width"], asking, find_negatives, "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

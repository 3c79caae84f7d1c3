"""Near-duplicate documents by MinHash with odd sketches.

A document's set holds its distinct word shingles. Documents with equal sets are one
class from the start. Each class gets ``BANDS * ROWS`` MinHash samples, which are folded into
an odd sketch: every sample flips one bit of a 512-bit map. Classes that agree in all samples
of some band are candidates (a pair at similarity 0.8 is missed with probability
(1 - 0.8^6)^48, below one in a million). The popcount of two maps' XOR tells how many samples
differ, and so the similarity, sharply where it is high.

Candidates are verified in two steps, both on the full sets, with integers. First each class
is held against one of the classes that stand for its bands, the one whose sketch is
nearest; the confirmed links join most families whole, and each text travels once for that.
Classes that hang together by bands but fall into several confirmed clusters are then
compared with each other: in blocks, dealt to a grid of block pairs that together see every
pair, sketches first, never inside one cluster, and only links that join clusters are put
out, so no pair list of a group ever exists. Blocks are bounded by rows and by bytes.

Edge cases: null and empty texts, and texts without words, have an empty set and stand
alone; texts shorter than a shingle are one shingle; rows that share a doc_id are one
document, linked by each of its texts; rows with a null doc_id stand alone with a null
component and are kept; other columns are ignored by the query and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrow_text import let_go, slices, texts_as_bytes
from foliomill.operators.graph import connected_components
from foliomill.plans.workspace import materialize

BANDS, ROWS, BITS = 48, 6, 512
SAMPLES = BANDS * ROWS
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
FOLD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
#: how far the estimated similarity may lie under the threshold before a pair is dropped unseen: over six deviations
MARGIN = 0.2


class WordHashes(dict):
    """word -> 64-bit hash, for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    acc = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        acc = (acc ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def minhash(found: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    seeds = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(seeds), 1024):
        np.minimum(low, (seeds[at : at + 1024, None] * MULTIPLY + ADD).min(0), out=low)
    return low


def band_keys(samples: np.ndarray) -> list[int]:
    rows = samples.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(rows)]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity map of the samples as 64-bit words."""
    spot = ((samples.astype(np.uint64) + np.uint64(1)) * FOLD) >> np.uint64(64 - 9)
    odd = np.bincount(spot.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def estimate(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity estimated from XOR popcounts: with d differing bits, -B/2 ln(1 - 2d/B) samples fell apart, two a sample."""
    differ = np.bitwise_count(others ^ sketch).sum(1).astype(float)
    apart = -BITS / 2 * np.log(np.maximum(1 - 2 * differ / BITS, 1e-6))
    return 1 - apart / (2 * SAMPLES)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null for an empty set), bands, sketch (eight longs)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 1, 1 << 20)):
            sizes, keys, bands, sketches = [], [], [], []
            for text in texts_as_bytes(batch.column(1)):
                found = shingle_set(text, shingle, hashes)
                sizes.append(len(found))
                samples = minhash(found) if len(found) else None
                keys.append(None if samples is None else xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(None if samples is None else band_keys(samples))
                sketches.append(None if samples is None else odd_sketch(samples).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def linked(common, size, other, percent: int):
    """Whether two sets are near: 100 * |common| >= percent * |union|."""
    return 100 * common >= percent * (size + other - common)


def joining_links(sets: list[np.ndarray], sketches: np.ndarray, clusters: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what ``clusters`` leaves apart: a spanning forest of all true ones between different clusters."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    _, first = np.unique(every[order], return_index=True)
    ends = np.append(first[1:], len(every))
    holders = owner[order]
    place = np.empty(len(every), np.int64)
    place[order] = np.repeat(np.arange(len(first)), ends - first)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    clusters, links = clusters.copy(), []
    for at in range(n - 1):
        left = at + 1 + np.flatnonzero(clusters[at + 1 :] != clusters[at])
        small, large = np.minimum(sizes[left], sizes[at]), np.maximum(sizes[left], sizes[at])
        left = left[100 * small >= percent * large]
        left = left[estimate(sketches[at], sketches[left]) >= percent / 100 - MARGIN]
        if not len(left):
            continue
        mine = place[begins[at] : begins[at + 1]]
        common = np.bincount(np.concatenate([holders[first[s] : ends[s]] for s in mine]), minlength=n)[left]
        for other in left[linked(common, sizes[at], sizes[left], percent)]:
            if clusters[other] != clusters[at]:
                links.append((at, int(other)))
                clusters[clusters == clusters[other]] = clusters[at]
    return links


def sketch_estimate(a: Column, b: Column) -> Column:
    """As ``estimate``, of two sketch columns."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n).cast("double")
    return 1 + F.lit(BITS / 4 / SAMPLES) * F.log(F.greatest(1 - 2 * differ / BITS, F.lit(1e-6)))


def _pick(group: pa.Table, shingle: int, hashes: WordHashes) -> tuple[list[int], list[np.ndarray]]:
    """(row, set) of the rows whose text has the set of their class, each class of a cell once."""
    rows, sets, seen = [], [], set()
    for n, (cell, cls, key, text) in enumerate(zip(group["cell"].to_pylist(), group["cls"].to_pylist(), group["set_key"].to_pylist(), texts_as_bytes(group["text"].combine_chunks()))):
        if (cell, cls) in seen:
            continue
        found = shingle_set(text, shingle, hashes)
        if xxhash.xxh3_128_digest(found.tobytes()) == key:
            seen.add((cell, cls))
            rows.append(n)
            sets.append(found)
    return rows, sets


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; ``kept`` is true for the first document of a component."""
    signed = materialize(signatures(docs, shingle), "minhash-signatures")
    known = signed.where("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("text_hash", "bands", "sketch", "n_shingles"), F.struct("doc_id", "text_hash")).alias("of"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "set_key", "rep", "of.text_hash", "of.bands", "of.sketch", "of.n_shingles"), "minhash-classes")

    banded = classes.select("cls", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("cls").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = materialize(banded.join(shared, "band").where("cls <> low").select(F.col("cls").alias("src"), F.col("low").alias("dst")).distinct(), "minhash-candidates")

    # first step: each class against the nearest of those that stand for its bands
    traits = lambda end: classes.select(F.col("cls").alias(end), F.col("sketch").alias(f"{end}_sketch"), F.col("n_shingles").alias(f"{end}_size"))
    nearest = near.join(traits("src"), "src").join(traits("dst"), "dst").withColumn("likely", sketch_estimate(F.col("src_sketch"), F.col("dst_sketch")))
    nearest = nearest.where((100 * F.least("src_size", "dst_size") >= percent * F.greatest("src_size", "dst_size")) & (F.col("likely") >= percent / 100 - MARGIN))
    nearest = materialize(nearest.groupBy("src").agg(F.max_by("dst", F.struct("likely", -F.col("dst"))).alias("dst"), F.first("src_size").alias("size")), "minhash-nearest")
    # about nine bytes of text a shingle; a head's followers are cut into parts, parts are dealt to tasks by their hash:
    # small ones, so that a task that gets several is not far above the others
    few = max(1, block // 8)
    heads = nearest.groupBy("dst").agg(F.greatest(F.ceil(F.count(F.lit(1)) / few), F.ceil(F.sum("size") * 9 / block_bytes)).cast("int").alias("parts"))
    follow = nearest.join(heads, "dst").select("dst", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int").alias("part"), F.col("src").alias("cls"), F.lit(False).alias("head"))
    lead = heads.select("dst", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("dst").alias("cls"), F.lit(True).alias("head"))
    weight = nearest.agg(F.sum("size"), F.count(F.lit(1))).first()
    tasks = max(1, int((weight[0] or 0) * 9 // block_bytes), weight[1] // (2 * few))
    # a class is asked for by the id and the text that stand for it: of many texts under one id only that one; rows that repeat are one
    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null")
    again = known.groupBy(F.col("doc_id").alias("rep"), "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = materialize(again, "minhash-repeated")
    if not again.isEmpty():
        once = texts.join(again, ["rep", "text_hash"], "left_semi").groupBy("rep", "text_hash").agg(F.first("text").alias("text"))
        texts = texts.join(again, ["rep", "text_hash"], "left_anti").unionByName(once)
    # texts move once: those of all classes that share a band, for both steps; written ids first, so that where they are few Spark sends them to the texts
    wanted = near.select(F.col("src").alias("cls")).unionByName(near.select(F.col("dst").alias("cls"))).distinct()
    wanted = materialize(wanted.join(classes.select("cls", "rep", "text_hash", "set_key", "sketch"), "cls"), "minhash-wanted")
    banded_texts = materialize(wanted.join(texts, ["rep", "text_hash"]).select("cls", "set_key", "sketch", "text"), "minhash-texts")

    def confirm(group: pa.Table) -> pa.Table:
        group = group.sort_by([("dst", "ascending"), ("part", "ascending"), ("head", "descending")])
        group = group.append_column("cell", pa.array([f"{a}/{b}" for a, b in zip(group["dst"].to_pylist(), group["part"].to_pylist())], pa.string()))
        rows, sets = _pick(group, shingle, WordHashes())
        dst, cls, head, cell = (group[c].to_pylist() for c in ("dst", "cls", "head", "cell"))
        src, to, of, of_cell = [], [], None, None
        for row, found in zip(rows, sets):
            if head[row]:
                of, of_cell = found, cell[row]
            elif of_cell == cell[row] and linked(len(np.intersect1d(found, of, assume_unique=True)), len(found), len(of), percent):
                src.append(cls[row])
                to.append(dst[row])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(to, pa.int64())})

    met = materialize(follow.unionByName(lead), "minhash-met").join(banded_texts.drop("sketch"), "cls").select("dst", "part", "cls", "head", "set_key", "text")
    confirmed = met.groupBy(F.pmod(F.xxhash64("dst", "part"), F.lit(tasks)).alias("task")).applyInArrow(confirm, "src long, dst long")
    # rows of one document are linked by that
    twice = known.join(classes.select("set_key", "cls"), "set_key").groupBy("doc_id").agg(F.min("cls").alias("src"), F.max("cls").alias("dst"), F.collect_set("cls").alias("all")).where("src <> dst")
    same = twice.select("src", F.explode("all").alias("dst")).where("src <> dst")
    confirmed = materialize(confirmed.unionByName(same), "minhash-confirmed")
    clusters = materialize(connected_components(confirmed).select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "minhash-clusters")

    # second step: what bands hold together and the first step left apart
    candidates = connected_components(near).select(F.col("node").alias("cls"), F.col("component").alias("candidate"))
    members = candidates.join(clusters, "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls")).join(classes.select("cls", "n_shingles"), "cls")
    open_ones = members.groupBy("candidate").agg(
        F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") * 9 / block_bytes)).cast("int").alias("parts")
    )
    members = materialize(members.join(open_ones.where("low <> high").select("candidate", "parts"), "candidate").drop("n_shingles"), "minhash-open")
    links = confirmed
    if not members.isEmpty():
        # a block meets itself and every other block of its component in some cell of the grid
        here, there = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        cells = members.withColumn("here", here).withColumn("there", there)
        cells = cells.select("cls", "cluster", F.concat_ws("/", "candidate", F.least("here", "there"), F.greatest("here", "there")).alias("cell"))

        def settle(group: pa.Table) -> pa.Table:
            rows, sets = _pick(group, shingle, WordHashes())
            cls, found = group["cls"].to_pylist(), []
            if len(sets) > 1:
                take = group.take(pa.array(rows))
                sketches = np.array(take["sketch"].to_pylist(), np.int64).view(np.uint64)
                found = joining_links(sets, sketches, np.unique(take["cluster"].to_numpy(), return_inverse=True)[1], percent)
            return pa.table({"src": pa.array([cls[rows[a]] for a, _ in found], pa.int64()), "dst": pa.array([cls[rows[b]] for _, b in found], pa.int64())})

        joined = materialize(cells, "minhash-cells").join(banded_texts, "cls").select("cell", "cls", "cluster", "set_key", "sketch", "text")
        links = materialize(joined.groupBy("cell").applyInArrow(settle, "src long, dst long").unionByName(confirmed), "minhash-links")
        clusters = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    clusters = materialize(classes.select("set_key", "cls", "rep").join(clusters, "cls"), "minhash-clustered")
    # written, so that adaptive execution can split a large cluster in the join; classes without links stand for themselves
    lowest = materialize(clusters.groupBy("cluster").agg(F.min("rep").alias("component")), "minhash-lowest")
    by_class = clusters.join(lowest, "cluster").select("cls", "component")
    by_class = classes.select("set_key", "cls", "rep").join(by_class, "cls", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id."""
    gone = materialize(near_duplicates(docs, **options).where("not kept").select("doc_id").distinct(), "minhash-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

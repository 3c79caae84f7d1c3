"""Removal of long repeated strings by longest previous factors at content anchors.

A byte goes if a string of ``length`` bytes that covers it has another occurrence
(``keep_first``: an earlier one). No task can hold the order of all suffixes of a whole
collection, so it is thinned out and cut into parts that can't separate equal strings: every
string of ``length`` bytes has an anchor, the smallest hash among its 64-byte grams, at the
same place in all its copies. Strings are dealt by anchor, and an anchor that occurs once has
no repeated string, so only the surroundings of repeated anchors are sent around.

Among the occurrences of one anchor, the suffixes that begin there are put in order, as are
the texts before it, read backwards. The longest common prefix of two suffixes plus that of
the texts before them is the factor that both places share; where it reaches ``length``, the
bytes of the factor are covered. Small groups are compared in one matrix of common lengths,
large ones by the classes that their orders, cut at each length, fall into. There bytes decide
and hashes only say where to look. Stretches that repeat themselves at a short distance (long
rows of dashes) are settled inside their text, and only one period of them is sent.

Anchors of more than ``hot`` occurrences would make one group too large. Of these, equal
surroundings (128-bit hashes of their bytes) are put together by a Spark aggregation first: they
cover each other, and one of them stands for all, which leaves few of a passage that very many texts
share. Anchors that are below ``hot`` by then are ordered like the others. What is left, at
the edges of such passages, is spelled out as 128-bit hashes of its strings, and each is
compared with the first and last place of equal ones in a Spark aggregation, which splits
them over all tasks.

Texts are handled once per distinct text; rows with equal texts are copies of each other.

Edge cases: null is the empty text; texts shorter than ``length`` stay whole; repeated
rows are copies; cuts may fall inside a character, so ``kept`` is binary; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrow_text import slices, texts_as_bytes
from foliomill.plans.workspace import materialize

GRAM = 64
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
PIECE = 1 << 20
PART_BYTES = 1 << 21
#: up to so many different surroundings of one anchor are compared in one matrix
MATRIX = 24
_PLACE = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, for a piece of text."""
    inverse = np.uint64(pow(int(BASES[base]), -1, 1 << 64))
    up, down = np.full(PIECE + 1024, BASES[base]), np.full(PIECE + 1024, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """Hash of every gram of ``size`` bytes; ``data`` is at most a piece long."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(base)
    # bytes are spread over 64 bits first: sums of small numbers are equal too often in regular texts
    spread = _mix(np.arange(1, 257, dtype=np.uint64) * BASES[1 - base])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(spread[data] * up[: len(data)], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(rows of hash, place, first start, last start; own copies as begin, distance, end).

    A row is a stretch of strings whose anchors are equal; ``place`` is the anchor of its
    first string. A stretch that equals itself ``distance`` bytes further on, from ``begin``
    until ``end`` of the copy, is an own copy, and its strings after the first
    ``distance`` ones are left out of the rows.
    """
    parts, own = [], []
    for at in range(0, max(1, len(data) - length + 1), PIECE - length):
        piece = data[at : at + PIECE - 1]
        if len(piece) < length:
            break
        hashes = gram_hashes(piece, GRAM)
        spots = np.arange(len(hashes), dtype=np.uint64)
        low = _sliding_min((hashes & ~_PLACE) | spots, length - GRAM + 1)[: PIECE - length]
        place = (low & _PLACE).astype(np.int64)
        value = hashes[place]
        cut = np.flatnonzero(value[1:] != value[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(low) - 1]])
        rows = np.stack([value[first].view(np.int64), place[first], first, last], 1)
        several = np.flatnonzero((place[last] != place[first]) & (last - first > 2 * length))
        if len(several):
            rows, copies = _without_own_copies(piece, length, rows, several, place)
            own += [(b + at, d, e + at) for b, d, e in copies]
        rows[:, 1:] += at
        parts.append(rows)
    return (np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)), own


def _without_own_copies(data: np.ndarray, length: int, rows: np.ndarray, several: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    kept, own = [np.delete(rows, several, 0)], []
    for h, _, first, last in rows[several].tolist():
        steps, often = np.unique(np.diff(np.unique(place[first : last + 1])), return_counts=True)
        distance = int(steps[often.argmax()])
        seg = data[first : last + length]
        a, b = _runs(seg[:-distance] == seg[distance:])
        starts = [first]
        for u, v in zip(a.tolist(), b.tolist()):
            if v - u + 1 >= length:
                own.append((first + u, distance, first + v + 1 + distance))
                starts += [first + u + distance, first + v + 2 - length + distance]
        starts.append(last + 1)
        kept += [np.array([[h, place[i], i, j - 1]]) for i, j in zip(starts[::2], starts[1::2]) if i < j]
    rows = np.concatenate(kept)
    return rows[np.argsort(rows[:, 2], kind="stable")], own


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def anchored(stretch: bytes, place: int, length: int) -> list[tuple[int, int, int]]:
    """(place, first start, last start) for each place of the anchor that is the first one in some string of a stretch."""
    gram, out, begin, most = stretch[place : place + GRAM], [], 0, len(stretch) - length
    while True:
        out.append((place, begin, min(place, most)))
        if place >= most:
            return out
        begin = place + 1
        place = stretch.find(gram, begin)
        if place < 0:
            return out


def _matrix_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of one matrix, and their lengths; the padding equals nothing in another row."""
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    padded = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    return padded, sizes


def common_lengths(texts: list[bytes]) -> np.ndarray:
    """Lengths of the common prefixes of all pairs."""
    padded, sizes = _matrix_of(texts)
    same = np.logical_and.accumulate(padded[:, None] == padded[None], axis=2).sum(2, dtype=np.int64)
    return np.minimum(same, np.minimum(sizes[:, None], sizes[None]))


def ordered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the texts, longest common prefix of each with the one before it in that order; -1 for the first)."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    padded, sizes = _matrix_of([texts[i] for i in order])
    same = np.logical_and.accumulate(padded[1:] == padded[:-1], axis=1).sum(1, dtype=np.int64)
    return np.array(order), np.concatenate([[-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])


def shared_factors(before: list[bytes], suffixes: list[bytes], rank: np.ndarray, length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """How far the factors that an anchor's places share with others (``keep_first``: of smaller rank) reach back and ahead.

    ``before`` are the texts before the places, read backwards, ``suffixes`` those that
    begin there. (0, 0) where no factor has ``length`` bytes.
    """
    n = len(rank)
    if n <= MATRIX:
        back, ahead = common_lengths(before), common_lengths(suffixes)
        valid = (back + ahead >= length) & ((rank[None] < rank[:, None]) if keep_first else ~np.eye(n, dtype=bool))
        return (back * valid).max(1), (ahead * valid).max(1)
    order_b, prefix_b = ordered(before)
    order_s, prefix_s = ordered(suffixes)
    sizes_b, sizes_s = np.array([len(x) for x in before]), np.array([len(x) for x in suffixes])
    reach_back, reach_ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    class_b, class_s = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(length - GRAM + 1):
        # strings that begin ``back`` bytes before the anchor are equal if both sides fall into one class at these lengths
        class_b[order_b] = np.cumsum(prefix_b < back)
        class_s[order_s] = np.cumsum(prefix_s < length - back)
        there = np.flatnonzero((sizes_b >= back) & (sizes_s >= length - back))
        if not len(there):
            continue
        key = class_b[there] * (n + 1) + class_s[there]
        in_order = np.lexsort((rank[there], key))
        same = key[in_order][1:] == key[in_order][:-1]
        hit = np.zeros(len(there), bool)
        hit[in_order[1:]] = same
        if not keep_first:
            hit[in_order[:-1]] |= same
        found = there[hit]
        reach_back[found] = back
        reach_ahead[found] = np.maximum(reach_ahead[found], length - back)
    return reach_back, reach_ahead


def repeated_spans(stretches: list[bytes], places: list[int], rank: np.ndarray, length: int, keep_first: bool) -> Iterator[tuple[int, int, int]]:
    """(stretch, begin, end) of what other occurrences cover; ``rank`` orders the stretches by position."""
    groups: dict[bytes, dict[tuple[bytes, bytes], list[tuple[int, int]]]] = {}
    for n, (stretch, first) in enumerate(zip(stretches, places)):
        for place, begin, end in anchored(stretch, first, length):
            around = stretch[begin:place][::-1], stretch[place : end + length]
            groups.setdefault(stretch[first : first + GRAM], {}).setdefault(around, []).append((n, place))
    for group in groups.values():
        heads, before, suffixes = [], [], []
        for (back, suffix), members in group.items():
            members.sort(key=lambda x: (rank[x[0]], x[1]))
            # surroundings that are equal all over: every place but the first has an earlier one, and the first a later one
            for n, place in members[1:] if keep_first else members if len(members) > 1 else ():
                yield n, place - len(back), place + len(suffix)
            heads.append(members[0])
            before.append(back)
            suffixes.append(suffix)
        if len(heads) == 1:
            continue
        position = np.empty(len(heads), np.int64)
        position[sorted(range(len(heads)), key=lambda i: (rank[heads[i][0]], heads[i][1]))] = np.arange(len(heads))
        back, ahead = shared_factors(before, suffixes, position, length, keep_first)
        for i in np.flatnonzero(ahead).tolist():
            # what holds for the first place of equal surroundings holds for all of them
            for n, place in group[before[i], suffixes[i]] if not keep_first else [heads[i]]:
                yield n, int(place - back[i]), int(place + ahead[i])


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = False, digest: bool = False, hot: int = 20_000, bucket: int = 8_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary), or with ``digest`` its ``kept_sha256``."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    texts = keyed.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in _parts(batches, 2):
            found = []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2))):
                if (a, b) in seen or len(data) < length:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((a, b))
                rows, own = anchors(np.frombuffer(data, np.uint8), length)
                hashes, place = rows[:, 0], rows[:, 1]
                # an anchor that a stretch holds twice, or that has an own copy, occurs twice
                again = np.flatnonzero(rows[:, 3] > place)
                inside = np.isin(np.arange(len(rows)), np.searchsorted(rows[:, 2], [o[0] for o in own], side="right") - 1) if own else np.zeros(len(rows), bool)
                again = np.union1d(again, np.flatnonzero(inside))
                hashes, place = np.concatenate([hashes, hashes[again]]), np.concatenate([place, -1 - place[again]])
                found.append((np.full(len(hashes), a), np.full(len(hashes), b), hashes, place))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["t1", "t2", "h", "place"])

    found = materialize(keyed.select("t1", "t2", "text").mapInArrow(find, "t1 long, t2 long, h long, place long"), "repeat-found")
    occurrence = F.xxhash64("t1", "t2", "place")
    repeated = found.groupBy("h").agg(F.min(occurrence).alias("low"), F.max(occurrence).alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    repeated = materialize(repeated.select("h", "n"), "repeat-repeated")
    # at most 1,024 anchors can stand for over a 1,024th of all occurrences each: their rows are found without a shuffle
    often = F.broadcast(repeated.where(F.col("n") > found.count() / 1024))
    marked = found.select("h", "t1", "t2").join(often, "h", "left")
    wanted = marked.where("n is not null").unionByName(marked.where("n is null").drop("n").join(repeated, "h"))
    is_hot = F.col("n") > hot
    wanted = materialize(wanted.groupBy("t1", "t2").agg(F.collect_set(F.when(~is_hot, F.col("h"))).alias("cool"), F.collect_set(F.when(is_hot, F.col("h"))).alias("hot")), "repeat-anchors")
    count = repeated.agg(F.sum(F.when(~is_hot, F.col("n"))), F.sum(F.when(is_hot, F.col("n")))).first()
    buckets = max(1, int(count[0] or 0) // bucket)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 3):
            columns, held = [[] for _ in range(8)], 0
            for t1, t2, first, data, cool, heated in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_as_bytes(batch.column(3)), *(batch.column(i).to_pylist() for i in (4, 5))):
                rows, own = anchors(np.frombuffer(data, np.uint8), length)
                found = [(h, place, begin, end, is_hot) for keep, is_hot in ((cool, False), (heated, True)) if keep for h, place, begin, end in rows[np.isin(rows[:, 0], np.array(keep, np.int64))].tolist()]
                sent = [(t1, t2, first, begin, h, place - begin, is_hot, data[begin : end + length]) for h, place, begin, end, is_hot in found]
                sent += [(t1, t2, first, begin + (distance if keep_first else 0), end, None, None, None) for begin, distance, end in own]
                for row in sent:
                    for column, value in zip(columns, row):
                        column.append(value)
                    held += len(row[7] or b"")
                    if held > PART_BYTES:
                        yield _stretches(columns, batch.column(2).type)
                        columns, held = [[] for _ in range(8)], 0
            yield _stretches(columns, batch.column(2).type)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"t1 long, t2 long, first {id_kind}, begin long, h long, place int, hot boolean, bytes binary"
    sent = texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "first", "text", "cool", "hot").mapInArrow(cut, shape)
    spans = "t1 long, t2 long, begin long, end long"

    def order(group: pa.Table) -> pa.Table:
        copies = group.filter(pc.is_null(group["bytes"]))  # own copies are spans already
        group = group.filter(pc.is_valid(group["bytes"]))
        t1, t2, begin = (group[c].to_numpy() for c in ("t1", "t2", "begin"))
        # stretches in document order, so that "earlier" means the smaller doc_id
        rank = np.empty(group.num_rows, np.int64)
        first = pc.rank(group["first"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        rank[np.lexsort((begin, t2, t1, first))] = np.arange(group.num_rows)
        found = list(repeated_spans(group["bytes"].to_pylist(), group["place"].to_pylist(), rank, length, keep_first))
        row = np.array([x[0] for x in found], np.int64)
        out = pa.table({"t1": t1[row], "t2": t2[row], "begin": begin[row] + np.array([x[1] for x in found], np.int64), "end": begin[row] + np.array([x[2] for x in found], np.int64)})
        return pa.concat_tables([out, copies.select(["t1", "t2", "begin", "h"]).rename_columns(out.column_names)])

    parts = [sent.where("hot is null or not hot").groupBy(F.pmod("h", F.lit(buckets))).applyInArrow(order, spans)]
    position = F.struct("first", "t1", "t2", "begin")
    if count[1]:
        # most of a passage that very many texts hold is alike all around its anchors: equal stretches are covered by each other, and one of them stands for all
        hot_ones = materialize(sent.where("hot").withColumns({"k1": F.xxhash64("bytes"), "k2": F.xxhash64(F.lit(1), "bytes")}), "repeat-hot")
        alike = ["h", "place", "k1", "k2"]
        groups = hot_ones.groupBy(*alike).agg(F.min(position).alias("low"), F.count(F.lit(1)).alias("n"))
        groups = materialize(groups, "repeat-alike")
        members = hot_ones.select(*alike, "first", "t1", "t2", "begin", (F.col("begin") + F.octet_length("bytes")).alias("end"))
        members = members.join(groups.where("n > 1"), alike).where(position > F.col("low") if keep_first else F.lit(True))
        parts.append(members.select("t1", "t2", "begin", "end"))
        heads = hot_ones.join(groups.select(*alike, "low"), alike).where(position.eqNullSafe(F.col("low")))
        heads = materialize(heads.select("t1", "t2", "first", "begin", "h", "place", "bytes"), "repeat-heads")
        still = materialize(heads.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "repeat-still-hot")
        again = heads.join(still.select("h"), "h", "left_anti").select(*heads.columns)
        parts.append(again.groupBy(F.pmod("h", F.lit(max(1, heads.count() // bucket)))).applyInArrow(order, spans))

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _parts(batches, 4):
                for t1, t2, first, begin, stretch in zip(*(batch.column(i) for i in range(4)), batch.column(4).to_pylist()):
                    grams = np.frombuffer(stretch, np.uint8)
                    keys = [pa.array(gram_hashes(grams, length, base).view(np.int64)) for base in (0, 1)]
                    n = len(keys[0])
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.repeat(x, n) for x in (t1, t2, first)), pa.array(begin.as_py() + np.arange(n))], names=["k1", "k2", "t1", "t2", "first", "begin"])

        spelled = heads.join(still.select("h"), "h", "left_semi").select("t1", "t2", "first", "begin", "bytes").mapInArrow(spell, f"k1 long, k2 long, t1 long, t2 long, first {id_kind}, begin long")
        ends = spelled.groupBy("k1", "k2").agg(F.min(position).alias("low"), F.max(position).alias("high")).where("low <> high")
        again = spelled.join(ends, ["k1", "k2"]).where(position > F.col("low") if keep_first else F.lit(True))
        parts.append(again.select("t1", "t2", "begin", (F.col("begin") + length).alias("end")))
    covered = reduce(DataFrame.unionByName, parts)
    covered = materialize(covered.groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("covered")), "repeat-spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 2):
            out = []
            for data, copies, found in zip(texts_as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if copies > 1 and not keep_first and len(data) >= length:
                    merged = [(0, len(data))]
                else:
                    merged = merge_spans([(x["begin"], x["end"]) for x in found or ()])
                kept = data if not merged else b"".join(data[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(data)]))
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest() if digest else kept))
            last = pa.string() if digest else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], last)], names=["t1", "t2", "n_bytes", "n_removed", "n_spans", result])

    result = "kept_sha256" if digest else "kept"
    kept = texts.select("t1", "t2", "text", "copies", "first").join(covered, ["t1", "t2"], "left")
    shape = f"t1 long, t2 long, n_bytes long, n_removed long, n_spans long, {result} {'string' if digest else 'binary'}"
    judged = kept.select("t1", "t2", "text", "copies", "covered").mapInArrow(strip, shape)
    if digest:
        judged = materialize(judged, "repeat-results")
    out = keyed.select("doc_id", "t1", "t2").join(judged, ["t1", "t2"])
    if keep_first:
        later = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)
        firsts = keyed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))
        empty = F.sha2(F.lit(b""), 256) if digest else F.lit(b"")
        out = out.join(firsts, ["t1", "t2"]).select("doc_id", "n_bytes", F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(later, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(later, empty).otherwise(F.col(result)).alias(result))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", result)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, PART_BYTES)


def _stretches(columns: list[list], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), id_kind, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["t1", "t2", "first", "begin", "h", "place", "hot", "bytes"])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of a union of half-open ones."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]

"""Alignment of two tokenizers over the same texts, and how often their tokens meet in a whole collection.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with byte
fallback) the text, to which it adds that space itself; so both spell the same bytes. The
running sums of token lengths are the tokens' ends. Each tokenizer gives a dictionary from
end to index; the keys that both dictionaries hold, sorted, slice both id lists into groups,
and in each slice every pair of tokens whose byte ranges overlap is a link.

Texts are cut before spaces and line ends that follow a visible character: neither
tokenizer has a token across such a place (for A by its pattern, for B it is checked on its
pieces; where the check fails texts are not cut), so both end a token there and the segments
can be aligned one by one. What a segment gave is kept for the next one like it, in a table
of bounded size. Texts run through in windows of segments.

How many documents hold an id pair is counted in two steps: documents are dealt to blocks of
bounded text; a block puts out its distinct pairs once, with the number of its documents
that hold them, and its documents refer to them by position. Blocks' pairs are summed over
the collection and sent back to the blocks, never a pair of each document.

Edge cases: null and empty texts, and texts whose tokens don't spell them (U+2581, which B
reads as a space), have no tokens: zeros and an empty digest; special tokens' strings are
plain text; rows that share an id, or repeat, are documents of their own; a null id is kept;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrow_text import KEPT, let_go, slices
from foliomill.llm.bpe import byte_names, default_pattern, default_vocabulary
from foliomill.plans.workspace import materialize

SPACE = "▁"
#: from a space or line end behind a visible character to the next such place
SEGMENT = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
#: bounds of the table: segments, and characters in them; segments of a window; characters that are learned at once
SEGMENT_TABLE, HELD = 200_000, 4_000_000
WINDOW, LEARNED = 200_000, 200_000
#: an id pair as one number: A's id above, B's id in the low bits
LOW = 32


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def align(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common ends in order, tokens of A up to each, tokens of B up to each): what lies between two of them is a group."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    ends = sorted(at_a.keys() & at_b.keys())
    return tuple(np.array(x, np.int64) for x in (ends, [at_a[e] for e in ends], [at_b[e] for e in ends]))


def expand(groups_a: np.ndarray, groups_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in A, index in B of all overlapping tokens, links up to each group's end), in order of their places.

    In a slice of m and n tokens whose last ends alone are common, the next link begins
    where a token of either side ends: m + n - 1 links.
    """
    upto = groups_a + groups_b - np.arange(1, len(groups_a) + 1)
    starts = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, starts), np.searchsorted(ends_b, starts), upto


class PairTokenizer:
    """Both tokenizers, and what they made of the segments met lately, by number."""

    def __init__(self, vocabulary: str, pieces: bytes, pattern: str) -> None:
        import json

        import sentencepiece
        import tiktoken

        names, spec = byte_names(), json.loads(vocabulary)
        special = {x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = [re.fullmatch(r"<0x([0-9A-F]{2})>", t) if self.b.is_byte(i) else None for i, t in enumerate(texts)]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else t.replace(SPACE, " ").encode() for t, m in zip(texts, byte)]
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        #: how an id is shown: A's before another of A and before B's, then B's before another of B and at the end
        self.shown = [f"{i}{mark}" for mark, n in ((",", len(self.bytes_a)), ("|", len(self.bytes_a)), (",", len(self.bytes_b)), (";", len(self.bytes_b))) for i in range(n)]
        #: B has no piece across a cut, and its added space is a piece of its own before a line end
        self.cuts = not any("\n" in t or re.search(f"[^{SPACE}]{SPACE}", t) for t in texts)
        self.space = self.b.piece_to_id(SPACE)
        self.forget()

    def forget(self) -> None:
        """Empty tables: numbers of segments; by number, (tokens of A, of B, groups, links), groups' text and where in ``pairs`` the links' id pairs begin."""
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts, self.pairs, self.begins, self.held = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _keep(self, segments: list[str], counts: np.ndarray, texts: list[str], pairs: np.ndarray) -> None:
        first, links = len(self.texts), np.maximum(counts[:, 3], 0)
        self.numbers.update(zip(segments, range(first, first + len(segments))))
        self.begins = np.concatenate([self.begins, len(self.pairs) + np.cumsum(links) - links])
        self.counts, self.pairs = np.concatenate([self.counts, counts]), np.concatenate([self.pairs, pairs])
        self.texts += texts
        self.held += sum(map(len, segments))

    def _ids_b(self, text: str) -> list[int]:
        if text == " ":
            return [self.space]
        if text[0] == " ":
            return self.b.encode(text[1:], num_threads=1)
        return self.b.encode(text, num_threads=1)[1:]  # without the added space

    def _learn(self, segments: list[str]) -> None:
        """Align segments that may stand behind each other; where the tokens don't spell them, each for itself."""
        text = "".join(segments)
        ids_a, ids_b = self.a.encode_ordinary(text), self._ids_b(text)
        raw = text.encode()
        spelled = b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))
        if not spelled and len(segments) > 1:
            for segment in segments:
                self._learn([segment])
            return
        if not spelled:
            self._keep(segments, np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.int64))
            return
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        ends, upto_a, upto_b = align(ends_a.tolist(), ends_b.tolist())
        of_a, of_b, upto_links = expand(upto_a, upto_b, ends_a, ends_b)
        pairs = ids_a[of_a] << LOW | ids_b[of_b]
        # groups' texts: all tokens, A's and B's of a group in turn, each with its mark
        group_a, group_b = np.repeat(np.arange(len(ends)), np.diff(upto_a, prepend=0)), np.repeat(np.arange(len(ends)), np.diff(upto_b, prepend=0))
        order, last = np.empty(len(ids_a) + len(ids_b), np.int64), len(self.bytes_a)
        before_b = np.concatenate([[0], upto_b])[:-1]
        order[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + np.where(np.isin(ends_a, ends, assume_unique=True), last, 0)
        order[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * last + ids_b + np.where(np.isin(ends_b, ends, assume_unique=True), len(self.bytes_b), 0)
        shown = list(map(self.shown.__getitem__, order.tolist()))
        # a segment ends where both tokenizers end a token
        upto = np.searchsorted(ends, np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in segments]), "right")
        behind = np.stack([upto_a[upto - 1], upto_b[upto - 1], upto, upto_links[upto - 1]], 1)
        marks = [0, *(behind[:, 0] + behind[:, 1]).tolist()]
        self._keep(segments, np.diff(behind, axis=0, prepend=0), ["".join(shown[a:b]) for a, b in zip(marks, marks[1:])], pairs)

    def learn(self, segments: list[str]) -> list[int]:
        """Numbers of segments, old and new."""
        numbers = self.numbers
        missing = list(dict.fromkeys(s for s in segments if s not in numbers))
        part, size = [], 0
        for segment in missing:
            # the last segment of a text may end in white space, and nothing may stand behind it
            if not self.cuts or segment[-1].isspace():
                self._learn([segment])
                continue
            part.append(segment)
            size += len(segment)
            if size > LEARNED:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)
        return list(map(numbers.__getitem__, segments))

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each whole text (tokens of A, of B, groups, links, digest of the groups, distinct id pairs, times of each)."""
        done = [[np.zeros(4, np.int64), hashlib.sha256(), False, [], []] for _ in texts]
        for window in self._windows(texts):
            if len(self.numbers) > SEGMENT_TABLE or self.held > HELD:
                self.forget()
            numbers = self.learn([s for _, segments in window for s in segments])
            at = np.cumsum([0, *(len(segments) for _, segments in window)])
            where = np.array(numbers, np.int64)
            counts = self.counts[where]
            links = counts[:, 3]
            spots = np.repeat(self.begins[where] - np.cumsum(links) + links, links) + np.arange(links.sum())
            ids, place = np.unique(self.pairs[spots], return_inverse=True)
            owner = np.repeat(np.repeat(np.arange(len(window)), np.diff(at)), links)
            keys, times = np.unique(owner * max(1, len(ids)) + place, return_counts=True)
            cut = np.searchsorted(keys, np.arange(len(window) + 1) * max(1, len(ids)))
            for n, (doc, _) in enumerate(window):
                mine = done[doc]
                here = counts[at[n] : at[n + 1]]
                if here[:, 0].min() < 0:
                    mine[2] = True
                    continue
                shown = "".join(map(self.texts.__getitem__, numbers[at[n] : at[n + 1]]))
                # the mark behind the last group of a window stands before the next one's first
                mine[1].update((shown[:-1] if not mine[0][0] else ";" + shown[:-1]).encode())
                mine[0] += here.sum(0)
                mine[3].append(ids[keys[cut[n] : cut[n + 1]] - n * max(1, len(ids))])
                mine[4].append(times[cut[n] : cut[n + 1]])
        out = []
        for (a, b, groups, links), digest, broken, pairs, times in done:
            if broken or not pairs:
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            else:
                ids, n = (pairs[0], times[0]) if len(pairs) == 1 else _summed(np.concatenate(pairs), np.concatenate(times))
                out.append((int(a), int(b), int(groups), int(links), digest.hexdigest(), ids, n))
        return out

    def _windows(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """(number of the text, segments), of all texts in order, so many segments at a time."""
        window, size = [], 0
        for n, text in enumerate(texts):
            spaced = " " + text
            found = (m[0] for m in SEGMENT.finditer(spaced)) if self.cuts and len(text) > HELD else iter(SEGMENT.findall(spaced) if self.cuts else [spaced])
            while text and (part := list(islice(found, WINDOW))):
                window.append((n, part))
                size += len(part)
                if size >= WINDOW:
                    yield window
                    window, size = [], 0
        if window:
            yield window


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    ids, place = np.unique(keys, return_inverse=True)
    return ids, np.bincount(place, values, len(ids)).astype(np.int64)


@lru_cache(maxsize=1)
def _tokenizers(vocabulary: str, pieces: bytes, pattern: str) -> PairTokenizer:
    return PairTokenizer(vocabulary, pieces, pattern)


KEPT["alignment"] = _tokenizers.cache_clear


def _lists(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list column; None becomes null."""
    sizes = [0 if p is None else len(p) for p in parts]
    flat = np.concatenate([np.zeros(0, np.int64), *[p for p in parts if p is not None]])
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    nulls = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind), mask=nulls)


def aligned_blocks(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Rows of documents and, at the end of each block of them, a ``summary`` row.

    A document's ``at`` and ``times`` tell which of its block's pairs it holds and how often;
    a summary's ``pairs`` are the block's distinct ones, ``times`` how many documents hold each.
    The vocabulary files are read by the driver and sent to the executors.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    with open(pieces or default_pieces(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(base64.b64encode(f.read()))
    pattern = pattern or default_pattern()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(but="alignment")
        tokenizers = _tokenizers(spec.value, base64.b64decode(model.value), pattern)
        block = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, 1, block_bytes)):
            found = tokenizers.documents([t or "" for t in batch.column(1).to_pylist()])
            held = [f[5] for f in found]
            pairs, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            at, times = [*(np.searchsorted(pairs, h) for h in held), None], [*(f[6] for f in found), n]
            rows = len(found)
            numbers = [pa.array([*(f[i] for f in found), None], pa.int64()) for i in range(4)]
            keys = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
            columns = [pa.array([block] * (rows + 1), pa.int64()), pa.array([False] * rows + [True]), keys, *numbers, pa.array([*(f[4] for f in found), None], pa.string()), _lists(at, pa.int32()), _lists(times, pa.int32()), _lists([None] * rows + [pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "summary", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs"])
            block += 1

    return docs.select(key, text).mapInArrow(run, f"block long, summary boolean, {key} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents an id pair is linked, and whether no other pair of its A id is in more."""
    held = blocks.where("summary").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    held = materialize(held, "alignment-counts")
    of_a = F.shiftright("pair", LOW).alias("a")
    most = held.groupBy(of_a).agg(F.max("count").alias("most"))
    return held.withColumn("a", of_a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is in as many documents as any of its A id;
    ``count_sum`` is the sum of the links' document counts.
    """
    blocks = materialize(aligned_blocks(docs, key=key, **options), "alignment-blocks")
    asked = blocks.where("summary").select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    rows = blocks.where("not summary").drop("summary", "pairs")
    kind = docs.schema[key].dataType.simpleString()
    kept = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def weigh(held: pa.Table, known: pa.Table) -> pa.Table:
        size = held.num_rows
        order = np.argsort(known["place"].to_numpy(), kind="stable")
        counts, best = known["count"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order]
        at, times = held["at"].combine_chunks(), held["times"].combine_chunks()
        of = np.repeat(np.arange(size), np.diff(at.offsets.to_numpy())) if size else np.zeros(0, np.int64)
        spots, n = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        total = lambda values: _whole_sums(of, values, size)
        sums = {"n_best": total(n * best[spots]), "count_sum": total(n * counts[spots])}
        return pa.table({**{c: held[c] for c in kept}, **{c: pa.array(v, pa.int64()) for c, v in sums.items()}})

    schema = f"{key} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(weigh, schema)


def _whole_sums(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of integers by owner (ascending), without going through floats."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.searchsorted(owner, np.arange(size), "right")
    return running[ends] - running[np.concatenate([[0], ends[:-1]])] if size else np.zeros(0, np.int64)

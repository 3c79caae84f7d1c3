"""Language-model scoring by subword lattice likelihood.

A word's lattice holds every way to spell it with the pieces of an existing subword
vocabulary; a log-space forward recursion sums over all of them, so a text's score is its
marginal probability and not that of one segmentation. Pieces don't reach over white
space, so a document's log probability is the sum over its words and its end.

The vocabulary's own scores are ranks; 1 / (rank + 100), normalised, turns them into
starting weights. One round of expectation maximisation over all distinct training words,
weighted by how often the collection has them, makes piece probabilities of them (forward and
backward sums give each piece's expected count). ``score`` is the likelihood under these,
``prior_score`` (single precision) the one under the starting weights. Characters that the vocabulary lacks are
spelled by its byte pieces.

The collection is read once. Each task turns a stretch of documents into a block: its distinct
words, and per document word numbers and counts. Word counts are summed over all blocks,
words are scored once per distinct word, and each block gets back the numbers of its own
words by a join; text is never shuffled, nor is a row per token.

Edge cases: null texts count as empty and have one token, the end; without training texts
all counts are 0; repeated rows count as often as they stand; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.arrow_text import slices, texts_as_bytes
from foliomill.plans.workspace import materialize

BLOCK_BYTES = 24 << 20
WORD_MARK = "▁"
END = "</s>"


class PieceTrie:
    """The vocabulary as a trie of code points with sorted transitions, for lookups by array."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        """``pieces``: (piece, score) in the order of ids; byte pieces are written <0xNN>."""
        self.size = len(pieces)
        rank = np.array([max(0.0, -score) for _, score in pieces])
        usable = np.array([score > -1e8 for _, score in pieces])
        self.byte_ids = np.full(256, -1)
        edges: dict[tuple[int, int], int] = {}
        self.ends = [-1]
        for i, (piece, _) in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif piece == END:
                self.end_id = i
            elif usable[i] and not (piece.startswith("<") and piece.endswith(">") and len(piece) > 2):
                state = 0
                for c in map(ord, piece):
                    state = edges.setdefault((state, c), len(self.ends))
                    if state == len(self.ends):
                        self.ends.append(-1)
                self.ends[state] = i
        keys = sorted((s << 21 | c, t) for (s, c), t in edges.items())
        self.keys, self.targets = np.array([k for k, _ in keys]), np.array([t for _, t in keys])
        self.ends = np.array(self.ends)
        rank[self.byte_ids[self.byte_ids >= 0]] = self.size
        weight = np.where(usable, 1 / (rank + 100), 0.0)
        self.prior = np.maximum(weight / weight.sum(), 1e-12)

    def lattice(self, words: list[str]) -> dict[str, np.ndarray]:
        """All arcs of the words' lattices over one run of positions; word i owns base[i] .. base[i + 1]."""
        lengths = np.array([len(w) + 1 for w in words])
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        # one position more than characters per word; the last is its end and starts no arc
        chars = np.frombuffer((WORD_MARK + f"\0{WORD_MARK}".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        limit = np.repeat(base[1:] - 1, lengths + 1)
        alive = np.flatnonzero(np.arange(base[-1]) < limit)
        state, begin, end, piece = np.zeros(len(alive), np.int64), [], [], []
        single = np.zeros(base[-1], bool)
        starts, reach = alive, alive.copy()
        while len(alive):
            key = state << 21 | chars[reach]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[at] == key
            alive, reach, state = alive[fits], reach[fits] + 1, self.targets[at[fits]]
            done = self.ends[state] >= 0
            begin.append(alive[done])
            end.append(reach[done])
            piece.append(self.ends[state[done]])
            single[alive[done & (reach == alive + 1)]] = True
            inside = reach < limit[alive]
            alive, reach, state = alive[inside], reach[inside], state[inside]
        strange = starts[~single[starts]]
        spelled = {c: [int(self.byte_ids[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in np.unique(chars[strange]).tolist()}
        return {"base": base, "begin": np.concatenate([*begin, strange]), "end": np.concatenate([*end, strange + 1]), "piece": np.concatenate([*piece, np.full(len(strange), -1)]), "strange": chars[strange], "spelled": spelled}


def _arc_weights(lat: dict, log_p: np.ndarray) -> np.ndarray:
    out = log_p[lat["piece"]]
    if len(lat["strange"]):
        by_char = {c: float(sum(log_p[i] for i in ids)) for c, ids in lat["spelled"].items()}
        out[-len(lat["strange"]) :] = [by_char[c] for c in lat["strange"].tolist()]
    return out


def _sum_paths(to: np.ndarray, source: np.ndarray, weight: np.ndarray, depth: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Log-space recursion: value[to] = log sum exp(value[source] + weight), in order of ``depth``; 0 at ``begin``."""
    value = np.full(size, -np.inf)
    value[begin] = 0
    order = np.lexsort((to, depth))
    to, source, weight, depth = to[order], source[order], weight[order], depth[order]
    cuts = np.flatnonzero(np.diff(depth)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)]):
        if a == b:
            break
        v = value[source[a:b]] + weight[a:b]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(to[a:b])) + 1])
        top = np.maximum.reduceat(v, heads)
        spread = np.repeat(top, np.diff(np.append(heads, b - a)))
        value[to[a + heads]] = top + np.log(np.add.reduceat(np.exp(v - spread), heads))
    return value


def _batches(words: list[str], most: int = 150_000) -> Iterator[list[int]]:
    """Numbers of words of like lengths, ``most`` characters at once."""
    part, held = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if part and held + len(words[i]) > most:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(words[i]) + 2
    if part:
        yield part


def word_log_probabilities(trie: PieceTrie, log_p: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability, all segmentations summed."""
    out = np.zeros(len(words))
    for part in _batches(words):
        lat = trie.lattice([words[i] for i in part])
        first = np.repeat(lat["base"][:-1], np.diff(lat["base"]))
        forward = _sum_paths(lat["end"], lat["begin"], _arc_weights(lat, log_p), lat["end"] - first[lat["begin"]], lat["base"][:-1], lat["base"][-1])
        out[part] = forward[lat["base"][1:] - 1]
    return out


def expected_counts(trie: PieceTrie, log_p: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, each taken so many times."""
    total = np.zeros(trie.size)
    for part in _batches(words):
        lat = trie.lattice([words[i] for i in part])
        base, weight = lat["base"], _arc_weights(lat, log_p)
        sizes = np.diff(base)
        first, last = np.repeat(base[:-1], sizes), np.repeat(base[1:] - 1, sizes)
        forward = _sum_paths(lat["end"], lat["begin"], weight, lat["end"] - first[lat["begin"]], base[:-1], base[-1])
        backward = _sum_paths(lat["begin"], lat["end"], weight, last[lat["begin"]] - lat["begin"], base[1:] - 1, base[-1])
        whole = forward[last[lat["begin"]]]
        each = np.exp(forward[lat["begin"]] + weight + backward[lat["end"]] - whole) * np.repeat(np.asarray(times)[part], sizes)[lat["begin"]]
        known = lat["piece"] >= 0
        total += np.bincount(lat["piece"][known], weights=each[known], minlength=trie.size)
        for c, x in zip(lat["strange"].tolist(), each[~known].tolist()):
            for i in lat["spelled"][c]:
                total[i] += x
    return total


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


BLOCKS = "block long, {id}, held_out boolean, n_words long, words array<int>, counts array<int>, number int, word binary, times long"


def word_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Document rows (``word`` null) and word rows (``number``, ``word``, ``times`` in training) of all blocks."""
    shape = BLOCKS.format(id=f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    names = [x.split()[0] for x in shape.split(", ")]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        spots: dict[bytes, int] = {}
        times: Counter = Counter()

        def words() -> pa.RecordBatch:
            n = len(spots)
            none = [pa.nulls(n, t) for t in (kind, pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            train = [times[i] for i in range(n)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), *none, pa.array(range(n), pa.int32()), pa.array(list(spots), pa.binary()), pa.array(train, pa.int64())], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch, 1, 1 << 22):
                n_words, all_words, all_counts = [], [], []
                for text, out in zip(texts_as_bytes(part.column(1)), part.column(2).to_pylist()):
                    tokens = text.lower().split()
                    held += len(text)
                    counted = Counter([spots.setdefault(t, len(spots)) for t in tokens])
                    n_words.append(len(tokens))
                    all_words.append(list(counted))
                    all_counts.append(list(counted.values()))
                    if not out:
                        times.update(counted)
                n = part.num_rows
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), part.column(0), part.column(2), pa.array(n_words, pa.int64()), pa.array(all_words, pa.list_(pa.int32())), pa.array(all_counts, pa.list_(pa.int32())), *none], names=names)
                if held > BLOCK_BYTES:
                    yield words()
                    spots.clear()
                    times.clear()
                    number, held = number + 1, 0
        if spots:
            yield words()

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(block, shape)


def score_documents(docs: DataFrame, held_out: Column, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior_score of every row of ``docs``."""
    trie = PieceTrie(read_vocabulary(vocabulary))
    shipped = docs.sparkSession.sparkContext.broadcast(trie)
    blocks = materialize(word_blocks(docs, held_out), "lm-blocks")
    rows, words = blocks.where("word is null").select("block", "doc_id", "held_out", "n_words", "words", "counts"), blocks.where("word is not null").select("block", "number", "word", "times")
    counts = materialize(words.groupBy("word").agg(F.sum("times").alias("c")), "lm-counts")
    n_words, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    train_docs = rows.where("not held_out").count()
    total, kinds = n_words + train_docs, distinct + (train_docs > 0)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, found = shipped.value, None
        for batch in batches:
            spelled = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            part = expected_counts(trie, np.log(trie.prior), spelled, batch.column(1).to_numpy())
            found = part if found is None else found + part
        if found is not None:
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(found[used], pa.float64())], names=["piece", "uses"])

    uses = np.zeros(trie.size)
    for r in counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        uses[r.piece] = r.uses
    uses[trie.end_id] += train_docs
    log_p = np.log((uses + trie.size * trie.prior) / (uses.sum() + trie.size * trie.prior.sum()))
    learned = docs.sparkSession.sparkContext.broadcast(log_p)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            found, prior = (word_log_probabilities(shipped.value, p, spelled) for p in (learned.value, np.log(shipped.value.prior)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array(prior, pa.float32())], names=["word", "c", "log_p", "log_prior"])

    weighed = counts.mapInArrow(weigh, "word binary, c long, log_p double, log_prior float")
    known = words.select(F.col("block").alias("of_block"), "number", "word").join(weighed, "word").select("of_block", "number", "c", "log_p", "log_prior")
    prior_end = float(np.log(trie.prior[trie.end_id]))
    base, end = math.log10(total + kinds + 1), float(log_p[trie.end_id])
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, prior_score double"

    def score(held: pa.Table, table: pa.Table) -> pa.Table:
        size = max(table.num_rows, 1)
        c, log_word, log_prior = np.zeros(size), np.zeros(size), np.zeros(size)
        c[table["number"].to_numpy()] = table["c"].to_numpy()
        log_word[table["number"].to_numpy()] = table["log_p"].to_numpy()
        log_prior[table["number"].to_numpy()] = table["log_prior"].to_numpy()
        flat = held["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        times = held["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(held.num_rows), held["words"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        add = lambda x: np.bincount(owner, weights=x * times, minlength=held.num_rows)
        tokens = held["n_words"].to_numpy() + 1
        base_score = add(np.log10(c + 1)[flat]) + math.log10(train_docs + 1) - tokens * base
        n_known = add((c > 0)[flat].astype(float)).astype(np.int64) + (train_docs > 0)
        return pa.table({"doc_id": held["doc_id"], "held_out": held["held_out"], "n_tokens": tokens, "n_known": n_known, "base_score": base_score, "score": (add(log_word[flat]) + end) / math.log(10), "prior_score": (add(log_prior[flat]) + prior_end) / math.log(10)})

    scored = rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(score, shape)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "prior_score")

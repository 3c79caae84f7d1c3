"""BPE encoding and decoding with a deterministic automaton compiled from the merges.

First the token automaton is built by merge gadgets. It accepts exactly the token sequences
that BPE can produce: it starts with one state and a loop per byte and takes in one gadget
per merge, in order. The gadget of ``a + b -> c`` adds arcs labelled ``c`` beside every path
``a b`` and then removes the arc ``b`` behind ``a``, since from now on that path is spelled
``c``. Its states are "the last token read". Written out, that is |tokens|^2 arcs, so it is
kept in factored form: each gadget records its cut (a, b) with its time and extends the two
*spines* of the new token (what stood at its left and right edge at which time). An arc
u -> v is there unless, at the time of a merge (x, y), x stood at the right edge of u and y
at the left edge of v.

Then the token automaton is turned into a deterministic one over bytes. An arc labelled
with a token is a path of its bytes through the trie of all tokens, so what may be going on
after some bytes of a word is a set of pairs (state where an arc began, trie node reached).
Such a set is one state of the byte automaton; it has one transition per byte, and it says
which token ends here, of which there is exactly one since every string has one accepted
spelling. A row of the transition table is compiled by this subset construction when a word
first needs it and is read from the table ever after; the table starts anew beyond
``ENTRY_TABLE`` entries, so its size is bounded.

Encoding follows the transitions byte by byte, forward only, noting the token that ends at
each byte; the tokens of the word are then read off from its end. Decoding emits the arc
labels (each token's bytes).

Edge cases: null text is encoded as the empty text (no ids; the hash of nothing); special
tokens standing in a text become their ids, as the vocabulary file says; very long words
take time linear in their length; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliomill.llm.arrow_text import KEPT, let_go

NEVER = 1 << 62
WORD_TABLE = 350_000
ENTRY_TABLE = 250_000


def byte_names() -> dict[str, int]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for code points from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names = {chr(b): b for b in visible}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}


class MergeAutomaton:
    """The automaton of a list of merges; tokens are given as bytes -> id."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.labels = {i: t for t, i in tokens.items()}
        self.cut: dict[tuple[int, int], int] = {}
        # spines from the innermost part outward: (token, time at which it is merged into the next one)
        self.left: dict[int, list[tuple[int, int]]] = {i: [(i, NEVER)] for t, i in tokens.items() if len(t) == 1}
        self.right: dict[int, list[tuple[int, int]]] = {i: [(i, NEVER)] for i in self.left}
        for time, (a, b) in enumerate(merges):
            self._add_gadget(time, tokens[a], tokens[b], tokens[a + b])
        #: token -> (its length, the one int object that stands for it in all results)
        self.lengths = {i: (len(self.labels[i]), i) for i in self.left}
        # the trie of all tokens that have arcs: node << 8 | byte -> node, and the token that a node spells
        self.child: dict[int, int] = {}
        self.spells: list[int] = [-1]
        self.inner: list[bool] = [True]
        for i in self.left:
            node = 0
            for byte in self.labels[i]:
                self.inner[node] = True
                step = node << 8 | byte
                node = self.child.get(step, 0)
                if not node:
                    node = self.child[step] = len(self.spells)
                    self.spells.append(-1)
                    self.inner.append(False)
            self.spells[node] = i
        self._clear()

    def _add_gadget(self, time: int, a: int, b: int, c: int) -> None:
        # no path a b, no arc c: an earlier gadget has cut it, or a part is never produced itself
        if a not in self.left or b not in self.left or not self._survives(a, b):
            return
        self.cut[a, b] = time
        if c not in self.left:
            self.left[c] = [*self.left[a][:-1], (a, time), (c, NEVER)]
            self.right[c] = [*self.right[b][:-1], (b, time), (c, NEVER)]

    def _survives(self, u: int, v: int) -> bool:
        """Whether no gadget cut the arc from state ``u`` labelled ``v``; the edges are walked in time."""
        edge_u, edge_v, i, j = self.right[u], self.left[v], 0, 0
        while True:
            (x, end_x), (y, end_y) = edge_u[i], edge_v[j]
            # of one merge's places the leftmost goes first: before the one that takes y away, after the one that takes x
            if (time := self.cut.get((x, y), NEVER)) < NEVER and time < end_x and time <= end_y:
                return False
            if end_x == end_y == NEVER:
                return True
            i, j = i + (end_x <= end_y), j + (end_y <= end_x)

    def _clear(self) -> None:
        """An empty table with the start state: no token read, at the trie's root."""
        self.numbers: dict[tuple[int, ...], int] = {((-1 << 24),): 0}
        self.members: list[tuple[int, ...]] = [((-1 << 24),)]
        #: state << 8 | byte -> next state << 24 | token that ends there
        self.table: dict[int, int] = {}

    def _compile(self, state: int, byte: int) -> int:
        """One entry of the transition table, by subset construction over (last token << 24 | trie node)."""
        going, ended, child, spells, inner = [], -1, self.child.get, self.spells, self.inner
        for member in self.members[state]:
            node = child((member & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            if ended < 0 <= spells[node] and (member < 0 or self._survives(member >> 24, spells[node])):
                ended = spells[node]
            if inner[node]:
                going.append(member & ~0xFFFFFF | node)
        key = (*going, ended << 24)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.members)
            self.members.append(key)
        entry = self.table[state << 8 | byte] = number << 24 | ended
        return entry

    def encode_word(self, word: bytes) -> list[int]:
        """Forward through the transition table; the tokens are read off from the end of the word."""
        if len(self.table) > ENTRY_TABLE:
            self._clear()
        follow, state = self.table.get, 0
        ends = array("i") if len(word) > 4096 else []
        note = ends.append
        for byte in word:
            entry = follow(state << 8 | byte)
            if entry is None:
                entry = self._compile(state, byte)
            note(entry & 0xFFFFFF)
            state = entry >> 24
        ids, at, lengths = [], len(word), self.lengths
        while at:
            size, token = lengths[ends[at - 1]]
            ids.append(token)
            at -= size
        ids.reverse()
        return ids


class _WordTable(dict):
    """Words met lately -> their ids."""

    def __init__(self, automaton: MergeAutomaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_TABLE:
            self.clear()
        ids = tuple(self.automaton.encode_word(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            self[word] = ids
        return ids


class BpeCodec:
    """Encoder and decoder of a byte-level BPE vocabulary file (its JSON text)."""

    def __init__(self, spec: str, pattern: str) -> None:
        parsed = json.loads(spec)
        names = byte_names()
        spelled = lambda token: bytes(names[c] for c in token)
        tokens = {spelled(t): i for t, i in parsed["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        self.automaton = MergeAutomaton(tokens, [(spelled(a), spelled(b)) for a, b in pairs])
        self.added = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.labels = self.automaton.labels | {i: t.encode() for t, i in self.added.items()}
        self.names = {i: str(i) for i in self.labels}
        self.words = _WordTable(self.automaton)
        self.split = regex.compile(pattern)
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, text: str) -> list[int]:
        words = self.words
        if self.special is None or not self.special.search(text):
            return [i for w in self.split.findall(text) for i in words[w]]
        out = []
        for part in self.special.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += [i for w in self.split.findall(part) for i in words[w]]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(spec: str, pattern: str) -> BpeCodec:
    return BpeCodec(spec, pattern)


KEPT["bpe"] = _codec.cache_clear


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.

    The vocabulary file is read by the driver and sent to the executors (its size is that
    of the vocabulary, not of the data). One pass without a shuffle.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(but="bpe")
        codec = _codec(spec.value, pattern)
        labels, names = codec.labels, codec.names
        for batch in batches:
            counts, hashes, decoded, lists = [], [], [], []
            for value in batch.column(1):
                flat = codec.encode(value.as_py() or "")
                counts.append(len(flat))
                hashes.append(hashlib.sha256(",".join([names[i] for i in flat]).encode()).hexdigest())
                back = b"".join([labels[i] for i in flat]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if ids:
                    lists.append(pa.array(flat, pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            fields = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                offsets = pa.array([0, *_running(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return docs.select(key, text).mapInArrow(run, schema)


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for c in counts:
        total += c
        yield total


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The texts of id lists: key, text (null ids: null text)."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value, pattern)
        for batch in batches:
            texts = [None if x.as_py() is None else codec.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")

import hashlib
import random

import pytest

pytest.importorskip("foliomill.llm.bpe")
from foliomill.llm import bpe
from foliomill.llm.queries import QUERIES
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(open(bpe.default_vocabulary(), encoding="utf-8").read(), bpe.default_pattern())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def naive_bpe(word, merges):
    parts = list(word)
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        rank = min(ranked)[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and merges.get((parts[i], parts[i + 1])) == rank:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_equals_naive_merging_for_random_merges():
    rng = random.Random(3)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        ids = {t.encode(): i for i, t in enumerate(tokens)}
        automaton = bpe.MergeAutomaton(ids, [(a.encode(), b.encode()) for a, b in merges])
        ranks = {p: i for i, p in enumerate(merges)}
        for _ in range(80):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 16)))
            assert [tokens[i] for i in automaton.encode_word(word.encode())] == naive_bpe(word, ranks)


def test_long_words_take_few_states_and_a_small_table_gives_the_same(codec, library, monkeypatch):
    rng = random.Random(7)
    words = ["a" * 200_000, "-=" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "日本" * 20_000, "ab" * 3]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [codec.encode(w) for w in words] == want
    before = len(codec.automaton.members)
    codec.automaton.encode_word(b"a" * 300_000)
    assert len(codec.automaton.members) == before
    # a word may be met with an empty table at any time
    monkeypatch.setattr(bpe, "ENTRY_TABLE", 3)
    assert [[t for w in codec.split.findall(x) for t in codec.automaton.encode_word(w.encode())] for x in words] == want


def test_every_state_has_one_token_per_byte(codec):
    automaton = codec.automaton
    automaton.encode_word(b" determinism")
    for key, entry in list(automaton.table.items())[:2000]:
        state, byte = key >> 8, key & 255
        ending = [t for m in automaton.members[state] if (n := automaton.child.get((m & 0xFFFFFF) << 8 | byte)) is not None and (t := automaton.spells[n]) >= 0 and (m < 0 or automaton._survives(m >> 24, t))]
        assert ending == [entry & 0xFFFFFF]


def test_codec_equals_the_library_and_round_trips(codec, library):
    rng = random.Random(5)
    parts = ["a", " ", "\n", "  ", "==", "é", "日", "'s", "12", "<|endoftext|>", "🙂", "\x00", " the", " ", "aaaa", "x" * 300]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = codec.encode(s)
        assert ids == library.encode(s, add_special_tokens=False).ids
        assert codec.decode(ids) == s == library.decode(ids, skip_special_tokens=False)


def test_query_on_the_whole_table(spark, sf, library):
    rows = {r.doc_id: r for r in QUERIES["op6_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_edge_cases(spark):
    schema = "doc_id long, text string, ids string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a a", "x"), (3, "word " * 30000, "x"), (3, "word " * 30000, "x")], schema)
    rows = bpe.bpe_encode(docs).collect()
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0] and len(rows) == 5
    texts = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert sorted(t.text for t in texts) == sorted((d.text or "") for d in docs.collect())
    assert bpe.bpe_encode(docs.limit(0)).count() == 0

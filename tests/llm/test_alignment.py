import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliomill.llm import alignment
from foliomill.llm.bpe import byte_names

COLUMNS = "doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256".split(", ")


def by_definition(texts):
    """Whole texts by the tokenizers' own libraries, every pair of tokens compared."""
    names, a_of = byte_names(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    a_of.no_truncation()
    a_of.no_padding()
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = {i: t for t, i in a_of.get_vocab().items()}
    spell_b = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        parts = [[bytes(names[c] for c in shown[i]) for i in a], [spell_b(i) for i in b]]
        whole = (" " + text).encode() if text else b""
        if any(b"".join(p) != whole for p in parts):
            a, b, parts = [], [], [[], []]
        spans = []
        for p in parts:
            at, found = 0, []
            for x in p:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in shared:
            groups.append(",".join(str(i) for i, (s, e) in zip(a, spans[0]) if low <= s and e <= end) + "|" + ",".join(str(i) for i, (s, e) in zip(b, spans[1]) if low <= s and e <= end))
            low = end
        docs.append((len(a), len(b), groups, links))
    held = Counter(p for d in docs for p in set(d[3]))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (len_a, len_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if len_a else "")
        for len_a, len_b, groups, links in docs
    ]


def run(spark, rows, schema="doc_id long, text string", **options):
    out = alignment.align_documents(spark.createDataFrame(rows, schema), **options)
    return [tuple(r[c] for c in COLUMNS) for r in out.collect()]


def test_groups_and_links_of_ends():
    ends, upto_a, upto_b = alignment.align([3, 6, 7], [2, 6, 7])
    assert ends.tolist() == [6, 7] and upto_a.tolist() == [2, 3] and upto_b.tolist() == [2, 3]
    a, b, upto = alignment.expand(upto_a, upto_b, np.array([3, 6, 7]), np.array([2, 6, 7]))
    assert list(zip(a, b)) == [(0, 0), (0, 1), (1, 1), (2, 2)] and upto.tolist() == [3, 4]


def test_equals_whole_texts_compared_pair_by_pair(spark):
    texts = [
        "The quick brown fox's tail", "", None, " ", "  ", "x ", "x  ", "\n", "\n\n x", "a\n b", "a\n  b", "a \n b\t c\t\td", "tab\tend\t", "naïve café Zażółć gęślą jaźń 日本語のテキスト 🙂🙃", "<|endoftext|> and <s> </s> <unk> <0x41>",
        "under▁score", "a b 　c d", "x\x1c y\x85 z", "unbelievableness counterrevolutionaries 1234567 3.14159", "The quick brown fox's tail", "é́ é", "﻿bom ​ zero", "'s 'll 'S", "a" * 3000,
    ]
    rng = random.Random(5)
    texts += ["".join(rng.choice(" \n\t.,'aeinrstABZ0123é日🙂-_") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    expected = [(i, *row) for i, row in enumerate(by_definition([t or "" for t in texts]))]
    rows = list(enumerate(texts))
    assert sorted(run(spark, rows)) == expected
    assert sorted(run(spark, rows, block_bytes=300)) == expected


def test_windows_and_full_tables_change_nothing(monkeypatch):
    texts = ["".join(f"word{i % 97} of line {i}\n" for i in range(900)), "", "two words", "under▁score " * 9, " " * 40]
    tokenizers = alignment.PairTokenizer(open(alignment.default_vocabulary()).read(), open(alignment.default_pieces(), "rb").read(), alignment.default_pattern())
    shown = lambda: [str(x) for x in tokenizers.documents(texts)]
    one = shown()
    assert [x[:5] for x in tokenizers.documents(texts)] == [(*r[:4], r[6]) for r in by_definition(texts)]
    tokenizers.cuts = False
    tokenizers.forget()
    assert shown() == one
    tokenizers.cuts = True
    for name, bound in (("WINDOW", 7), ("SEGMENT_TABLE", 20), ("LEARNED", 30), ("HELD", 50)):
        monkeypatch.setattr(alignment, name, bound)
        tokenizers.forget()
        assert shown() == one


def test_repeated_rows_other_ids_and_empty_tables(spark):
    rows = [("a", "same text", 1), ("a", "same text", 1), (None, "same text", 2), ("b", None, 3)]
    found = sorted(run(spark, rows, "doc_id string, text string, n_a int"), key=str)
    assert sorted(map(str, (r[0] for r in found))) == ["None", "a", "a", "b"]
    counts = {r[0]: r[6] for r in found}
    assert counts["a"] == counts[None] == 3 * next(r[4] for r in found if r[0] == "a") and counts["b"] == 0
    assert run(spark, []) == []


@pytest.mark.parametrize("a,b", [([1, 2, 3], [3]), ([3], [1, 2, 3]), ([2, 4], [1, 3, 4])])
def test_links_are_the_overlapping_ranges(a, b):
    spans = [list(zip([0, *x[:-1]], x)) for x in (a, b)]
    expected = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    _, upto_a, upto_b = alignment.align(a, b)
    i, j, upto = alignment.expand(upto_a, upto_b, np.array(a), np.array(b))
    assert list(zip(i, j)) == expected and upto[-1] == len(expected)

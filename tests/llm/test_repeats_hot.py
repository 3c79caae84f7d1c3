import random
import time

import pytest

pytest.importorskip("foliomill.llm.repeats")
from foliomill.llm import repeats

LENGTH = 200


def passages(n, size, seed=1):
    """Texts of their own round one passage that all of them hold, some cut at the edges."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(size // 7))
    return [" ".join(word() for _ in range(12)) + " " + shared[rng.choice([0, 0, 0, 40]) : len(shared) - rng.choice([0, 0, 90])] + " " + " ".join(word() for _ in range(9)) for _ in range(n)]


def rows_of(spark, texts, ids, kind, **options):
    docs = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
    return {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=LENGTH, **options).collect()}


@pytest.mark.parametrize("keep_first", [False, True])
def test_hot_anchors_give_the_same_rows(spark, keep_first):
    texts = passages(90, 900) + ["-" * 700, "=" * 700] * 2
    ids = list(range(len(texts)))
    plain = rows_of(spark, texts, ids, "long", keep_first=keep_first)
    assert sum(r[0] for r in plain.values()) > 50_000
    for hot in (40, 1):
        assert rows_of(spark, texts, ids, "long", keep_first=keep_first, hot=hot) == plain


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_any_type(spark, kind):
    texts = [*passages(12, 700), None, "short"]
    ids = [n if kind == "int" else f"d{n:03d}" for n in range(len(texts))]
    for hot, keep_first in ((20_000, True), (3, False), (3, True)):
        got = rows_of(spark, texts, ids, kind, hot=hot, keep_first=keep_first)
        expected = rows_of(spark, texts, list(range(len(texts))), "long", keep_first=keep_first)
        assert {ids[k]: v for k, v in expected.items()} == got
    nothing = rows_of(spark, texts, [None] * len(texts), kind, hot=3)
    assert list(nothing) == [None]


def test_a_passage_of_very_many_texts_takes_no_longer_a_byte(spark):
    seconds = []
    for n in (1_000, 6_000):
        texts = passages(n, 4_000, seed=n)
        began = time.time()
        got = rows_of(spark, texts, range(n), "long", hot=500)
        seconds.append((time.time() - began) / n)
        assert all(r[0] >= 3_500 for r in got.values())
    assert seconds[1] < 2 * seconds[0]

"""Quality rules by distribution divergence.

Every language gets two references, summed over all documents: the histogram of character
classes and that of its most common words (the rest in one bin). A document is compared
with the references of its language by Jensen-Shannon distance (base 2, from 0 to 1); a
distance above its limit fails the document. A sample of n words lies about 1 / sqrt(n)
off its own source, so each limit is ``limit + scatter / sqrt(words)``, and a guard skips
the comparison altogether below a minimum length.

Every language has its references, a row of at most 64 words and 14 classes. Up to
``broadcast_languages`` of them are broadcast. Beyond that they stay a table which is
joined to the documents by language, and the documents without a language are compared
with one block of about ``broadcast_languages`` after the other; the results are the same.
Documents of no language are compared with the nearest of all references.

Edge cases: null and empty texts have no words and fail the base rule; with no reference
(an empty table) there is nothing to diverge from; repeated rows count as often as they
stand; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.arrow_text import texts_as_bytes
from foliomill.plans.workspace import materialize

CONTINUATION, SPACE, UPPER, LOWER, DIGIT, STOP, COMMA, MARK, QUOTE, SYMBOL, OTHER, LEAD2, LEAD3, LEAD4 = range(14)
CLASSES = 14
SYMBOLS = b"#*$%&|<>"
FLUSH = 400_000


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for chars, kind in ((b" \t\n\v\f\r", SPACE), (b".", STOP), (b",", COMMA), (b"!?;:", MARK), (b"'\"()[]{}-", QUOTE), (SYMBOLS, SYMBOL)):
        table[list(chars)] = kind
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[0x80:0xC0] = CONTINUATION
    table[0xC0:0xE0], table[0xE0:0xF0], table[0xF0:] = LEAD2, LEAD3, LEAD4
    return table


CLASS_OF = _class_table()


def char_classes(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def repeated_window_words(words: list[bytes]) -> int:
    """Words standing in a 3-word window that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, n)
    if len(seen) == n:
        return 0
    if len(seen) < 1 << 20:
        keys = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * np.int64(len(seen)) + ids[2:]
    _, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[group] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def reference_table(docs: DataFrame, common_words: int = 64) -> DataFrame:
    """lang, classes (class, n), common (word, n), total: one row a language, in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def put_out() -> Iterator[pa.RecordBatch]:
            for lang, found in words.items():
                yield _counted(lang, list(found), [None] * len(found), list(found.values()))
            for lang, found in classes.items():
                yield _counted(lang, [None] * CLASSES, list(range(CLASSES)), found.tolist())
            words.clear()
            classes.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                words.setdefault(lang, Counter()).update(text.lower().split())
                classes[lang] = classes.get(lang, 0) + char_classes(text)
            if sum(map(len, words.values())) > FLUSH:
                yield from put_out()
        yield from put_out()

    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, word binary, class int, n long")
    counts = materialize(counts.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "reference-counts")
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    word_counts = counts.where("word is not null")
    top = word_counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= common_words)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("common"))
    classes = counts.where("class is not null").groupBy("lang").agg(F.collect_list(F.struct("class", "n")).alias("classes"))
    totals = word_counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return materialize(classes.join(top, "lang", "left").join(totals, "lang", "left").selectExpr(
        "lang", "classes.class as classes", "classes.n as class_counts", "common.word as words", "common.less as less", "coalesce(total, 0) as total"), "references")


def _reference(r: dict) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """Character classes, places of the common words, their counts with all others last."""
    classes = np.zeros(CLASSES)
    classes[r["classes"]] = r["class_counts"]
    words, n = [bytes(w) for w in r["words"] or ()], [-x for x in r["less"] or ()]
    return classes, {w: i for i, w in enumerate(words)}, np.array([*n, r["total"] - sum(n)], float)


def _distances(classes: np.ndarray, lower: Iterable[tuple[bytes, int]], reference: tuple) -> tuple[float, float]:
    known, spots, counts = reference
    hist = np.zeros(len(counts))
    for w, c in lower:
        hist[spots.get(w, -1)] += c
    return _classes_distance(classes, known), js_distance(hist, counts)


def _counted(lang: str, words: list, classes: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(words, pa.binary()), pa.array(classes, pa.int32()), pa.array(n, pa.int64())], names=["lang", "word", "class", "n"])


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def divergence_rules(docs: DataFrame, char_limit: float = 0.22, char_scatter: float = 1.3, word_limit: float = 0.26, word_scatter: float = 1.45, min_chars: int = 200, min_words: int = 50, broadcast_languages: int = 256, **reference_options) -> DataFrame:
    """Base counts, distances and verdict of every document (doc_id and the columns of ``FIGURES``)."""
    table = reference_table(docs, **reference_options)
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIGURES}"
    names = ["doc_id", *(x.split()[0] for x in FIGURES.split(", "))]

    def row(text: bytes, classes: np.ndarray, char_d: float, word_d: float) -> tuple:
        words = text.split()
        n, repeats = len(words), repeated_window_words(words)
        word_chars = int(classes.sum() - classes[CONTINUATION] - classes[SPACE])
        failed = n < 50 or 100 * repeats > 50 * n
        scale = math.sqrt(max(n, 1))
        diverges = (word_chars >= min_chars and char_d > char_limit + char_scatter / scale) or (n >= min_words and word_d > word_limit + word_scatter / scale)
        return n, word_chars, int(classes[SYMBOL]), duplicate_lines(text), repeats, failed, not failed and not diverges, char_d, word_d

    def judged(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=names)

    few = table.limit(broadcast_languages + 1).collect()
    if len(few) <= broadcast_languages:
        references = docs.sparkSession.sparkContext.broadcast({r.lang: _reference(r.asDict()) for r in sorted(few, key=lambda r: r.lang)})

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = references.value
            for batch in batches:
                rows = []
                for lang, text in zip(batch.column(1).to_pylist(), texts_as_bytes(batch.column(2))):
                    classes, lower = char_classes(text), Counter(text.lower().split()).items()
                    found = [_distances(classes, lower, known[each]) for each in ((lang,) if lang in known else known)]
                    rows.append(row(text, classes, *min(found, key=sum, default=(0.0, 0.0))))
                yield judged(batch.column(0), rows)

        return docs.select("doc_id", "lang", "text").mapInArrow(judge, shape)

    # a null text has no words and no classes: its distance to any reference is 0
    own = docs.where("lang is not null").select("doc_id", "lang", "text").join(table, "lang", "left")
    fields = ["classes", "class_counts", "words", "less", "total"]

    def judge_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reference = None, None
        for batch in batches:
            rows = []
            for i, text in enumerate(texts_as_bytes(batch.column(2))):
                lang, found = batch.column(1)[i].as_py(), (0.0, 0.0)
                classes = char_classes(text)
                if batch.column(3)[i].is_valid:
                    if lang != last:
                        last, reference = lang, _reference({f: batch.column(3 + k)[i].as_py() for k, f in enumerate(fields)})
                    found = _distances(classes, Counter(text.lower().split()).items(), reference)
                rows.append(row(text, classes, *found))
            yield judged(batch.column(0), rows)

    # documents without a language are compared with block after block, so that one block only is in memory
    bare = materialize(docs.where("lang is null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "no-language")
    blocks = -(-table.count() // broadcast_languages)
    best = None
    for block in range(blocks):
        found = table.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect()
        if not found:
            continue
        part = docs.sparkSession.sparkContext.broadcast({r.lang: _reference(r.asDict()) for r in found})

        def nearest(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text in texts_as_bytes(batch.column(1)):
                    classes, lower = char_classes(text), Counter(text.lower().split()).items()
                    out.append(min((sum(d), lang, *d) for lang, d in ((lang, _distances(classes, lower, r)) for lang, r in part.value.items())))
                kinds = (pa.float64(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([b[k] for b in out], kind) for k, kind in enumerate(kinds)]], names=["row", "both", "near", "char_d", "word_d"])

        each = bare.select("row", "text").mapInArrow(nearest, "row long, both double, near string, char_d double, word_d double")
        if best is not None:
            each = each.unionByName(best).groupBy("row").agg(F.min(F.struct("both", "near", "char_d", "word_d")).alias("x")).select("row", "x.*")
        best = materialize(each, "nearest-reference")
        part.unpersist()

    def judge_bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield judged(batch.column(0), [row(text, char_classes(text), char_d, word_d) for text, char_d, word_d in columns])

    others = bare.join(best, "row").select("doc_id", "text", "char_d", "word_d").mapInArrow(judge_bare, shape)
    return own.select("doc_id", "lang", "text", *fields).mapInArrow(judge_own, shape).unionByName(others)


def _classes_distance(found: np.ndarray, reference: np.ndarray) -> float:
    """Over the classes of characters other than white space and continuation bytes."""
    return js_distance(found[UPPER:].astype(float), reference[UPPER:].astype(float))

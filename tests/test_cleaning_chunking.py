import random

from pyspark.sql import functions as F

from foliomill.operators import chunking, cleaning
from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline


def pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "document_id string, page int, text string")


def cleaned(spark, texts, overrides=None, **options):
    p = pages(spark, texts)
    done = cleaning.clean(p, overrides=overrides, **options)
    return [r.text for r in done.pages.orderBy("page").collect()], done.report.first()


BODY = ["alpha", "bravo", "carbon", "delta", "echo", "fox", "golf", "hotel", "india", "julia", "kilo", "lima"]


def test_footer_goes_and_body_stays(spark):
    texts, report = cleaned(spark, [f"Body {b}.\nline two {b}\n\nRev 2 page {i} of 10" for i, b in enumerate(BODY[:10])])
    assert texts == [f"Body {b}.\nline two {b}" for b in BODY[:10]]
    assert (report.total_lines, report.stripped_lines, report.stripped_pct, report.safety_rail_triggered) == (30, 10, 33.33, True)


def test_tables_warnings_long_lines_and_rare_lines_stay(spark):
    table = "Zone | Wire\n-- | --\n1 | red"
    for repeated in (table, "Warning: disconnect power", "x" * 81):
        texts, report = cleaned(spark, [f"Body {b}.\n\n{repeated}" for b in BODY[:10]])
        assert report.stripped_lines == 0 and texts[0].endswith(repeated)
    texts, report = cleaned(spark, [f"Body {b}." + ("\n\nRare" if i < 3 else "") for i, b in enumerate(BODY * 2)])
    assert report.stripped_lines == 0
    assert cleaned(spark, [f"Body {b}.\n\nFoot" for b in BODY[:3]])[1].stripped_lines == 0


def test_overrides_restore_a_line(spark):
    overrides = spark.createDataFrame([("d", "Foot #")], "document_id string, normalized string")
    assert cleaned(spark, [f"Body {b}.\n\nFoot {i}" for i, b in enumerate(BODY)], overrides)[1].stripped_lines == 0


def test_structural_pages(spark):
    texts = ["Contents\n\nx", "Intro .... 1\nZones .... 2\nplain", "Normal prose.\nMore prose.", None]
    got = cleaning.structural_pages(pages(spark, texts)).orderBy("page").collect()
    assert [r.structural for r in got] == [True, True, False, False]


def test_repeated_headings_are_no_headings(spark):
    p = pages(spark, [f"Notice\n\nPart {b}\n\nText {b} here." for b in BODY[:3]])
    kinds = {r.block: r.kind for r in chunking.typed_blocks(p).collect()}
    assert kinds["Notice"] == "text" and kinds["Part alpha"] == "heading"


def test_atomic_blocks_are_not_split(spark):
    table = "\n".join(f"cell {i} | value {i}" for i in range(30))
    steps = "\n\n".join(f"{i}. turn screw {i}" for i in range(1, 12))
    p = pages(spark, [f"Intro text is here.\n\n{table}\n\n{steps}"])
    out = chunking.chunk_documents(p, most=50, overlap=10, least=0).orderBy("chunk_index").collect()
    assert sum(table in r.content for r in out) == 1 and sum("1. turn screw 1\n2. turn" in r.content and "11. turn" in r.content for r in out) == 1


def check_packing(blocks, chunks, most, overlap):
    """What holds for any packing: ``blocks`` are (text, tokens, atomic, heading), ``chunks`` (content, section) in order."""
    spans = []
    for content, _ in chunks:
        spans.append([next(i for i, b in enumerate(blocks) if b[0] == part) for part in content.split("\n\n")])
    big = [b[2] and b[1] > most for b in blocks]
    total = lambda span: sum(blocks[i][1] for i in span)
    assert all(s == list(range(s[0], s[-1] + 1)) for s in spans) and {i for s in spans for i in s} == set(range(len(blocks)))
    assert all(len(s) == 1 for s in spans for i in s if big[i])
    opened = []
    for n, span in enumerate(spans):
        end = spans[n - 1][-1] if n else -1
        new = [i for i in span if i > end]
        opened.append(new[0])
        # past its overlap and the block that opened it, a chunk only takes what fits
        assert new and (len(new) == 1 or total(span) <= most)
        if n + 1 < len(spans) and not big[span[-1]]:
            # it ends where the next block does not fit, or must stand alone
            assert big[span[-1] + 1] or total(span) + blocks[span[-1] + 1][1] > most
        begin = end + 1
        if n and not big[end] and not big[new[0]]:
            # the overlap is the shortest tail of the chunk before that is long enough, or all of it
            tails = [i for i in spans[n - 1] if total(range(i, end + 1)) >= overlap]
            begin = max(tails) if tails else spans[n - 1][0]
        assert span[0] == begin
    for (_, section), at in zip(chunks, opened):
        heads = [b[0] for b in blocks[: at + 1] if b[3]]
        assert section == (heads[-1] if heads else None)


def check_merging(before, after, least):
    """``before`` are (content, section, structural), ``after`` (content, section, section_type) in order."""
    tokens = lambda text: max(1, len(text) // 4)
    joined = [n > 0 and tokens(c) < least and not f and not before[n - 1][2] and before[n - 1][1] == s for n, (c, s, f) in enumerate(before)]
    starts = [n for n, j in enumerate(joined) if not j]
    assert len(after) == len(starts)
    for (content, section, kind), a, z in zip(after, starts, [*starts[1:], len(before)]):
        assert content == "\n\n".join(c for c, _, _ in before[a:z]) and section == before[a][1]
        assert kind == ("structural" if before[a][2] else "runt" if tokens(content) < least else None)


def test_packing_and_merging_keep_their_properties(spark):
    rng = random.Random(2)
    rows, blocks = [], {}
    for d in range(25):
        blocks[d], head = [], None
        for i in range(rng.randint(1, 25)):
            kind = rng.choice(["text", "text", "heading", "table"])
            text = f"{i}" + "x" * rng.choice([3, 30, 200, 500])
            head = text if kind == "heading" else head
            blocks[d].append((text, max(1, len(text) // 4), kind == "table", kind == "heading"))
            rows.append((d, 1, 10 * i, kind, text, "text", False, blocks[d][-1][1], head))
    df = spark.createDataFrame(rows, "document_id int, page int, pos int, kind string, block string, extraction_path string, structural boolean, tokens int, section string")
    packed = chunking.pack(df, 100, 20).withColumn("structural", F.pmod(F.hash("content"), F.lit(5)) == 0).withColumn("chunk_index", F.col("chunk_index") * 3)
    before, after = {}, {}
    for r in packed.orderBy("document_id", "chunk_index").collect():
        before.setdefault(r.document_id, []).append((r.content, r.section, r.structural))
    for r in chunking.merge_runts(packed, 40).orderBy("document_id", "chunk_index").collect():
        assert r.chunk_index == len(after.setdefault(r.document_id, []))
        after[r.document_id].append((r.content, r.section, r.section_type))
    for d in range(25):
        check_packing(blocks[d], [(c, s) for c, s, _ in before[d]], 100, 20)
        check_merging(before[d], after[d], 40)


def test_pipeline_runs_again_without_new_work(spark):
    pipeline = DocumentPipeline(HashingProvider(8))
    p = pages(spark, [f"Body {b} goes on for a while.\n\nMore {b} text." for b in BODY])
    done = pipeline.clean(p)
    clean, report = done.passed(), done.report
    chunks = pipeline.embed(pipeline.chunk(clean))
    rows = chunks.collect()
    assert rows and all(len(r.embedding) == 8 for r in rows) and not report.first().safety_rail_triggered
    assert pipeline.chunk(clean, done=chunks).count() == 0
    assert sorted(r.chunk_id for r in pipeline.embed(chunks).collect()) == sorted(r.chunk_id for r in rows)
    docs = spark.createDataFrame([("d", None)], "document_id string, doc_type string")
    assert pipeline.metadata(docs, p).first().doc_type == "other"
    done = pipeline.clean(pages(spark, [f"Body {b}.\n\nFoot" for b in BODY]))
    assert done.report.first().safety_rail_triggered and done.passed().count() == 0
    proceed = spark.createDataFrame([("d",)], "document_id string")
    assert pipeline.clean(pages(spark, [f"Body {b}.\n\nFoot" for b in BODY]), proceed=proceed).passed().count() == len(BODY)

from pyspark.sql import functions as F

from foliomill.functions import text as T


def values(spark, texts, column, schema="t string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_paragraphs_and_lines(spark):
    assert values(spark, ["a\n \t\nb\n\n\n c ", "", None, " x\ny "], T.paragraphs(F.col("t"))) == [["a", "b", "c"], [], [], ["x\ny"]]
    assert values(spark, ["a\r\nb\x0bc\x85\n d "], T.text_lines(F.col("t"))) == [["a", "b", "c", " d "]]


def test_normalize_and_protect(spark):
    assert values(spark, ["  Page 12  of\t340 ", "٣ pages"], T.normalize_line(F.col("t"))) == ["Page # of #", "# pages"]
    texts = ["Warning: hot", "warnings", "note: x", "note:x", "x" * 81, "x" * 80, "DANGER"]
    assert values(spark, texts, T.is_protected(F.col("t"))) == [True, False, False, True, True, False, True]


def test_tokens_headings_toc(spark):
    assert values(spark, ["", "abc", "abcdefgh", "é" * 9], T.estimate_tokens(F.col("t"))) == [1, 1, 2, 2]
    assert values(spark, ["## **Title** ", "Plain"], T.normalize_heading(F.col("t"))) == ["title", "plain"]
    texts = ["Intro ..... 12", "Zones   7", "Zones 7", "x .. 12345", "end.. 1 "]
    assert values(spark, texts, T.is_toc_line(F.col("t"))) == [True, True, False, False, True]


def test_block_kinds(spark):
    texts = ["a|b\n--|--\n1|2", "1. do\n2) then\nx", "Title", "A sentence.", "**Page:** 4", "one | cell", "1. Overview", "two\nlines", "x" * 81]
    kinds = values(spark, texts, T.block_kind(F.col("t"), T.is_heading_shaped(F.col("t"))))
    assert kinds == ["table", "procedure", "heading", "text", "text", "heading", "procedure", "text", "text"]
    assert values(spark, ["Title"], T.block_kind(F.col("t"), F.lit(False))) == ["text"]


def test_table_density_and_vision(spark):
    dense, prose = "\n".join(["ab"] * 20), "\n".join(["a long line of running prose here"] * 3)
    assert values(spark, [dense, prose, None], T.is_table_dense(F.col("t"))) == [True, False, False]
    assert values(spark, ["short", dense, prose * 2], T.needs_vision(F.col("t"), F.lit(True))) == [False, True, False]
    assert values(spark, [" NO_CONTENT\n", "NO_CONTENT x"], T.without_sentinel(F.col("t"))) == ["", "NO_CONTENT x"]


def test_repetition(spark):
    keep = ["a", "a\n\na", "a\n\nb\n\nc\n\nd", "row 1\n\nrow 2\n\nrow 3\n\nrow 4", None]
    assert values(spark, keep, T.cut_repetition(F.col("t"))) == keep
    texts = ["a\n\na\n\na", "x\n\na\n\n a \n\na\n\na\n\nend", "a\n\nb\n\na\n\nb\n\na\n\nb", "a b\n\na  b\n\na\tb"]
    assert values(spark, texts, T.cut_repetition(F.col("t"))) == ["a", "x\n\na", "a\n\nb", "a b"]


def test_metadata_replies(spark):
    texts = ['{"manufacturer": "Acme", "panel_model": "", "doc_type": "datasheet", "revision": null}', '```json\n{"doc_type": "poem"}\n```', 'Sure! {"revision": "B"} ok', "nothing"]
    got = values(spark, texts, T.parse_metadata(F.col("t")))
    assert [None if r is None else tuple(r) for r in got] == [("Acme", None, "datasheet", None), (None, None, "other", None), (None, None, "other", "B"), None]


def test_page_files_round_trip(spark):
    made = values(spark, ["body\nx"], T.read_page_file(T.write_page_file(F.lit("vision"), F.col("t"), F.lit(True))))[0]
    assert tuple(made) == ("vision", True, "body\nx")
    assert [tuple(x) for x in values(spark, ["<!-- path: vision -->\nt", "bare"], T.read_page_file(F.col("t")))] == [("vision", False, "t"), ("text", False, "bare")]
    assert values(spark, ["7", "1234"], T.page_file_name(F.col("t"))) == ["007.md", "1234.md"]


def test_labels(spark):
    assert values(spark, ["", None, "S"], T.chunk_label(F.col("t"), F.lit(3), F.lit(None).cast("int"))) == ["Chunk #3 (p.?)", "Chunk #3 (p.?)", "S (p.?)"]
    assert values(spark, ["x"], T.page_range(F.lit(2), F.lit(5))) == ["p.2–5"] and values(spark, ["x"], T.hue(F.lit(3))) == [53]
    assert values(spark, ["done", "failed", "odd", None], T.stage_index(F.col("t"))) == [4, -1, 0, 0]
    assert values(spark, [" a\t", " \t ", None, "\u00a0b\u3000"], T.form_text(F.col("t"))) == ["a", None, None, "b"]

import random

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.queries import QUERIES


def test_null_text_stays_null(spark, tmp_path):
    rows = [(0, None), (3, "a\nb\nc"), (1, "x"), (2, "a\nb\na\nb\na\nb\nz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cut for r in QUERIES["repetition_truncate_all"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 3: "a\n\nb\n\nc\n\nsame row", 1: "x\n\nsame row\n\nsame row\n\nend", 2: "a\n\nb"}


def cut(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.cut_repetition(F.col("t")).alias("x"))
    return [r.x for r in rows.collect()]


def test_a_loop_behind_a_lead_is_cut_to_one_copy(spark):
    """Texts made so that the answer is known: lead rows that differ, a cycle some times over, and whatever follows."""
    rng = random.Random(5)
    texts, answers = [], []
    for n in range(300):
        lead = [f"lead {n} {i}" for i in range(rng.randint(0, 5))]
        cycle = [f"row {i}" for i in range(rng.randint(1, 3))]
        copies = rng.randint(1, 6)
        spaced = [rng.choice(["{}", " {}", "{}  "]).format(x.replace(" ", rng.choice([" ", "  ", "\t"]))) for x in cycle * copies]
        rest = [f"rest {i}" for i in range(rng.randint(0, 3))]
        texts.append("\n\n".join([*lead, *spaced, *rest]))
        kept = [x.strip() for x in [*lead, *spaced[: len(cycle)]]]
        answers.append("\n\n".join(kept) if copies >= 3 else texts[-1])
    assert cut(spark, texts) == answers


def test_cycles_of_four_and_near_copies_stay(spark):
    four = "\n\n".join(["a", "b", "c", "d"] * 5)
    near = "\n\n".join(f"row {i}" for i in range(40))
    assert cut(spark, [four, near, "a\n\na", "a\n\nb\n\na\n\nb", "", "  "]) == [four, near, "a\n\na", "a\n\nb\n\na\n\nb", "", "  "]


def test_the_earliest_loop_counts_and_of_one_start_the_shortest(spark):
    assert cut(spark, ["x\n\nx\n\nx\n\ny\n\ny\n\ny", "a\n\nb\n\nb\n\nb\n\na\n\nb\n\nb\n\nb", "\n\n".join(["z"] * 9)]) == ["x", "a\n\nb", "z"]

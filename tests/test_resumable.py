import pytest
from pyspark.sql import functions as F

from foliomill.operators import providers, vectors
from foliomill.plans.documents import DocumentPipeline
from foliomill.queries import CountingProvider

SCHEMA = "chunk_id long, content string, embedding array<float>"


class Counted(CountingProvider):
    """Writes down every text that it is asked for; dies after some calls."""

    def __init__(self, log, lives=10**9):
        self.log, self.lives = log, lives

    def embed(self, texts):
        self.lives -= 1
        if self.lives < 0:
            raise ConnectionError("gone")
        with open(self.log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return super().embed(texts)


def asked(log):
    try:
        with open(log) as f:
            return f.read().split("\n")[:-1]
    except FileNotFoundError:
        return []


def chunks(spark, n):
    return spark.createDataFrame([(i, f"text {i}", None) for i in range(n)], SCHEMA).coalesce(1)


def run(spark, table, provider, store, **options):
    return {r.chunk_id: (r.embedding, r.embed_error) for r in vectors.embed_resumable(table, provider, store, **options).collect()}


def test_a_provider_that_dies_is_asked_for_the_rest_only(spark, tmp_path):
    store, log = str(tmp_path / "vectors"), str(tmp_path / "asked")
    first = run(spark, chunks(spark, 40), Counted(log, lives=3), store, batch=4)
    got = {i for i, (v, _) in first.items() if v is not None}
    assert len(got) == 12 == len(asked(log)) and all("gone" in e for i, (_, e) in first.items() if i not in got)
    second = run(spark, chunks(spark, 40), Counted(log), store, batch=4)
    assert all(v is not None and e is None for v, e in second.values()) and second[3][0] == [6.0, 1.0, 0.0]
    # every text was asked for once over both runs
    assert sorted(asked(log)) == sorted(f"text {i}" for i in range(40))
    assert run(spark, chunks(spark, 40), Counted(log), store) == second and len(asked(log)) == 40


def test_a_run_that_is_cut_short_keeps_its_rounds(spark, tmp_path, monkeypatch):
    store, log, real, rounds = str(tmp_path / "vectors"), str(tmp_path / "asked"), vectors.embed, []

    def dying(*args, **kwargs):
        rounds.append(1)
        if len(rounds) == 3:
            raise RuntimeError("lost driver")
        return real(*args, **kwargs)

    monkeypatch.setattr(vectors, "embed", dying)
    with pytest.raises(RuntimeError):
        run(spark, chunks(spark, 60), Counted(log), store, round_rows=20)
    before = asked(log)
    assert before and spark.read.parquet(store).count() == len(before)
    done = run(spark, chunks(spark, 60), Counted(log), store, round_rows=20)
    assert len(done) == 60 and sorted(asked(log)) == sorted(f"text {i}" for i in range(60))


def test_changed_and_repeated_rows(spark, tmp_path):
    store, log = str(tmp_path / "vectors"), str(tmp_path / "asked")
    rows = [(1, "a", None), (1, "a", None), (1, "bb", None), (2, None, None), (3, "known", [7.0])]
    out = vectors.embed_resumable(spark.createDataFrame(rows, SCHEMA), Counted(log), store)
    assert sorted((r.chunk_id, r.content or "", r.embedding[0]) for r in out.collect()) == [(1, "a", 1.0), (1, "a", 1.0), (1, "bb", 2.0), (2, "", 0.0), (3, "known", 7.0)]
    assert sorted(asked(log)) == ["", "a", "bb"]
    changed = [(1, "a", None), (2, "now", None)]
    vectors.embed_resumable(spark.createDataFrame(changed, SCHEMA), Counted(log), store).collect()
    assert sorted(asked(log)) == ["", "a", "bb", "now"]
    assert vectors.embed_resumable(spark.createDataFrame([], SCHEMA), Counted(log), str(tmp_path / "none")).count() == 0


def test_types_of_input(spark):
    class Typed(CountingProvider):
        def embed(self, texts, input_type="none"):
            return [[float(input_type == "query"), float(input_type == "passage")] for _ in texts]

    for provider in (Typed(), providers.PatientProvider(Typed())):
        assert vectors.query_vector(" what ", provider) == [1.0, 0.0]
        got = vectors.embed_pending(chunks(spark, 3), provider).collect()
        assert all(r.embedding == [0.0, 1.0] for r in got)
    assert vectors.query_vector("ab c", CountingProvider()) == [4.0, 1.0, 0.0]


def test_breaker_gives_up_and_recovers():
    calls, breaker = [], providers.Breaker(2)

    def fail():
        calls.append(1)
        raise ValueError("no")

    for _ in range(2):
        with pytest.raises(ValueError):
            breaker.call(fail)
    with pytest.raises(ConnectionError, match="not asked after 2 failures, the last: ValueError: no"):
        breaker.call(fail)
    assert len(calls) == 2
    other = providers.Breaker(2)
    with pytest.raises(ValueError):
        other.call(fail)
    assert other.call(lambda: 5) == 5 and other.failed == 0


def test_pipeline_asks_for_a_vector_once(spark, tmp_path):
    pages = spark.createDataFrame([("d", i, f"Page {i} says something of its own here.") for i in range(4)], "document_id string, page int, text string")
    documents = spark.createDataFrame([("d", "queued", None)], "document_id string, status string, error_message string")
    log = str(tmp_path / "asked")
    pipeline = lambda: DocumentPipeline(Counted(log), vector_store=str(tmp_path / "vectors"))
    first = pipeline().process(documents, pages)
    n = len(asked(log))
    again = pipeline().process(documents, pages)
    assert n > 0 and n == len(asked(log)) and first.chunks.count() == again.chunks.count() == 1
    assert again.chunks.where(F.col("embedding").isNull()).count() == 0

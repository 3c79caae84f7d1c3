"""Secret scans with collection-wide ownership frequency (DataFrame functions only).

Three base kinds are found by pattern: ``assign`` (a keyword, a separator, a value),
``access`` and ``hex``. A fourth, ``opaque``, takes long letter-digit runs that may be
credentials or not. All candidate values are hashed and counted over the whole collection by
distinct repositories (documents of an owner) and distinct owners (sources), summed in steps
so that no value and no owner gathers in one task. A value known to few owners is
owner-specific and counts as live, in however many of their repositories it stands; one that
many owners hold is a copied example. Both counts are returned with each span. Base spans always stay; opaque runs outside them are added as kind ``owned``
when they are owner-specific.

A text's matches leave the scan as gaps and lengths; positions are running sums of these in
windows over one text's matches, so the work grows in proportion to the matches, however
densely they stand.

Positions are code points, end exclusive. Edge cases: null text is scanned as the empty
text; a null source is an owner of its own; repeated rows get the same spans each; other
columns are ignored by the scan and kept by ``redact_secrets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.plans.workspace import materialize

KINDS = ("assign", "access", "hex", "owned")
#: kind -> (pattern, group of the value, least length of the value)
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "owned": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}", 0, 20),
}


def pattern_matches(text: Column, kind: str) -> Column:
    """All matches of a kind, left to right without overlap: array of (kind, n, gap before it, len, hash or null if too short)."""
    pattern, group, least = PATTERNS[kind]
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    pairs = F.zip_with(gaps, whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len")))
    digest = lambda v: F.when(F.length(v) >= least, F.substring(F.sha2(v, 256), 1, 32))
    items = F.zip_with(pairs, value, lambda s, v: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), digest(v).alias("hash")))
    found = F.transform(items, lambda x, n: F.struct(F.lit(KINDS.index(kind)).alias("kind"), n.alias("n"), x["gap"].alias("gap"), x["len"].alias("len"), x["hash"].alias("hash")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,n:int,gap:int,len:int,hash:string>>"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def judged_spans(docs: DataFrame, max_owners: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows with row, doc_id, text_hash; their spans: row, start, kind, end, repositories, owners, live)."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[pattern_matches(text, k) for k in KINDS])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"), found.alias("found"))
    rows = materialize(rows, "secret-candidates")

    each = rows.where("size(found) > 0").select("row", "doc_id", "source", F.explode("found").alias("x")).select("row", "doc_id", "source", "x.*").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("n")
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int")).where("hash is not null")
    spans = spans.select("row", "doc_id", "source", (F.col("end") - F.col("len")).alias("start"), "kind", "end", "hash")
    # opaque runs count where no base span meets them: none that began before reaches in, none begins before their end
    owned = F.col("kind") == KINDS.index("owned")
    reach = F.max(F.when(~owned, F.col("end"))).over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(~owned, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    spans = materialize(spans.withColumn("reach", reach).withColumn("ahead", ahead).where(~owned | free).drop("reach", "ahead"), "secret-spans")

    by_repository = spans.select("hash", "source", "doc_id").distinct()
    by_owner = by_repository.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("repositories"))
    counts = by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    counts = counts.withColumn("live", F.col("owners") <= max_owners)
    return rows.drop("found"), spans.join(counts, "hash").select("row", "start", "kind", "end", "repositories", "owners", "live")


def scan_secrets(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """Per row: doc_id, text_hash, counts, base_sha256, spans, and the spans as an array with their verdict and frequencies.

    A candidate is live if at most ``max_owners`` sources hold its value; in how many
    repositories of theirs is counted too, but a verdict does not depend on how large an owner
    is. ``frequencies`` lists repositories/owners of the spans in their order.
    """
    rows, spans = judged_spans(docs, max_owners)
    judged = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "repositories", "owners"))).alias("judged"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,repositories:bigint,owners:bigint>>")
    owned = KINDS.index("owned")
    out = rows.join(judged, "row", "left").withColumn("judged", F.coalesce("judged", none))
    base, kept = F.filter("judged", lambda s: s["kind"] != owned), F.filter("judged", lambda s: (s["kind"] != owned) | s["live"])
    count = lambda k: F.size(F.filter("judged", lambda s: s["kind"] == k)).cast("long")
    verdict = lambda live: F.size(F.filter("judged", lambda s: s["live"] == F.lit(live))).cast("long")
    return out.select(
        "doc_id", "text_hash",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(kept).alias("spans"),
        F.size(F.filter(kept, lambda s: s["kind"] == owned)).cast("long").alias("n_owned"),
        verdict(True).alias("n_live"), verdict(False).alias("n_examples"),
        F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws("/", s["repositories"].cast("string"), s["owners"].cast("string")))).alias("frequencies"),
        kept.alias("found"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every live span of its text replaced by ``mask``; copied examples stay readable.

    Overlapping spans (a hex value inside an assignment) are replaced as one. Null texts
    stay null; rows alike in doc_id and text are masked alike; all columns are kept.
    """
    rows, spans = judged_spans(docs, **options)
    in_order = Window.partitionBy("row").orderBy("start", "end")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    live = spans.where("live").withColumn("held", F.coalesce(F.max("end").over(before), F.lit(0)))
    live = live.withColumn("island", F.sum((F.col("start") >= F.col("held")).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = live.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("held").alias("after"))
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "after"))).alias("_secret_cuts"))
    hits = rows.join(cuts, "row").select(F.col("doc_id").alias("_secret_d"), F.col("text_hash").alias("_secret_t"), "_secret_cuts").dropDuplicates(["_secret_d", "_secret_t"])
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["_secret_d"]) & (F.xxhash64(docs["text"]) == hits["_secret_t"]), "left")
    text = docs["text"]
    cuts = hits["_secret_cuts"]
    pieces = F.transform(cuts, lambda s: F.concat(F.substring(text, s["after"] + 1, s["start"] - s["after"]), F.lit(mask)))
    rest = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
    masked = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.select(*[masked.alias("text") if c == "text" else docs[c] for c in docs.columns])

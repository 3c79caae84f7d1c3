"""The registered queries over the given tables, and SQL that gives the same rows.

Pages are documents' texts grouped by source, every line a paragraph; chunks with vectors
are the rows of ``embeddings``. Both follow the tables in size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions import text as T
from foliomill.operators import chunking, cleaning, flags, graph, store, triage, vectors, views
from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline
from foliomill.plans.ordering import positions
from foliomill.plans.scoped import DocumentStore
from foliomill.plans.workspace import ensure_code, materialize, shared_dir, spread
from foliomill.sources import files
from foliomill.streaming import ingest
from foliomill.streaming.components import ComponentStore

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_code(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def pages_of(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


#: A document of ``bounded_documents`` spans at most so many page numbers.
DOCUMENT_SPAN = 1000


def bounded_documents(spark, sf_dir):
    """The pages of ``pages_of``; a source is cut into documents by doc_id // DOCUMENT_SPAN, so none grows with the table."""
    part = F.floor(F.col("page") / DOCUMENT_SPAN).cast("string")
    return pages_of(spark, sf_dir).withColumn("document_id", F.concat_ws("/", "document_id", part))


def single_pages(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def chunks_of(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 10 == 0, "structural").when(F.col("vec_id") % 10 == 5, "runt")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document"), kind.alias("section_type"), F.when(F.col("vec_id") % 20 == 0, "true").alias("retrieval_override"), "embedding")


LINES = r"""lines AS (
  SELECT source AS document_id, doc_id AS page, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, n
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE trim(raw) <> ''),
marked AS (
  SELECT *, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '\d+', '#', 'g') AS normalized,
         length(line) <= 80 AND NOT regexp_matches(line, '(?i)\b(warning|caution|danger|note:)\b') AS candidate FROM lines)"""


def _furniture_sql(ratio: str) -> str:
    return f"""{LINES},
need AS (SELECT source AS document_id, greatest(5, CAST(ceil(count(*) * {ratio}::DOUBLE) AS INT)) AS need FROM documents GROUP BY 1),
furniture AS (
  SELECT m.document_id, normalized, count(DISTINCT page) AS page_count FROM marked m JOIN need USING (document_id)
  WHERE candidate GROUP BY m.document_id, normalized, need HAVING count(DISTINCT page) >= need)"""


@query(f"WITH {_furniture_sql('0.1')} SELECT * FROM furniture")
def furniture_lines(spark, sf_dir):
    return cleaning.furniture(pages_of(spark, sf_dir), min_ratio=0.1)


@query(f"WITH {_furniture_sql('0.3')} SELECT * FROM furniture")
def furniture_lines_default(spark, sf_dir):
    return cleaning.furniture(pages_of(spark, sf_dir))


@query(f"""WITH {_furniture_sql('0.1')}, first AS (
  SELECT document_id, normalized, page_count, page, arg_min(line, n) AS line, min(n) AS n FROM marked JOIN furniture USING (document_id, normalized) WHERE candidate GROUP BY ALL)
SELECT document_id, normalized, page_count, list(page ORDER BY page)[1:2] AS example_pages, list(line ORDER BY page)[1:2] AS example_lines,
  CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_count DESC, min(page), arg_min(n, page)) AS INT) AS rank FROM first GROUP BY 1, 2, 3""")
def furniture_examples(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    candidates = materialize(cleaning.candidate_lines(pages), "candidates")
    return cleaning.furniture_examples(candidates, cleaning.furniture(pages, candidates, 0.1))


def _cleaned(spark, sf_dir, **options):
    return cleaning.clean(pages_of(spark, sf_dir), 0.1, **options)


REPORT = f"""WITH {_furniture_sql('0.1')}, counts AS (
  SELECT m.document_id, count(*) AS total_lines, count(*) FILTER (candidate AND f.normalized IS NOT NULL) AS stripped_lines
  FROM marked m LEFT JOIN furniture f USING (document_id, normalized) GROUP BY 1),
report AS (
  SELECT document_id, total_pages, total_lines, stripped_lines, round(stripped_lines * 100.0::DOUBLE / total_lines, 2) AS stripped_pct
  FROM counts JOIN (SELECT source AS document_id, count(*) AS total_pages FROM documents GROUP BY 1) USING (document_id))"""


@query(f"{REPORT} SELECT *, stripped_pct > 15 AS safety_rail_triggered FROM report")
def clean_report(spark, sf_dir):
    return _cleaned(spark, sf_dir).report


@query(f"{REPORT} SELECT document_id, stripped_pct FROM report WHERE stripped_pct > 1")
def safety_rail(spark, sf_dir):
    return _cleaned(spark, sf_dir, rail_pct=1.0).report.where("safety_rail_triggered").select("document_id", "stripped_pct")


@query(f"""WITH {_furniture_sql('0.1')}, kept AS (
  SELECT document_id, page, string_agg(m.line, chr(10) || chr(10) ORDER BY n) AS text FROM marked m
  WHERE NOT (candidate AND EXISTS (SELECT 1 FROM furniture f WHERE f.document_id = m.document_id AND f.normalized = m.normalized)) GROUP BY 1, 2)
SELECT source AS document_id, doc_id AS page, coalesce(kept.text, '') AS text FROM documents LEFT JOIN kept ON document_id = source AND page = doc_id""")
def cleaned_pages(spark, sf_dir):
    return _cleaned(spark, sf_dir).pages.select("document_id", "page", "text")


ORDER_PAGES = r"""order_pages AS (
  SELECT o_custkey AS document_id, o_orderkey AS page, CASE
    WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Contents' ELSE 'See contents' END || chr(10) || chr(10) || 'Order ' || o_orderkey || ' was placed.'
    WHEN o_orderpriority LIKE '2%' THEN 'Panel ' || o_orderkey || ' ........ ' || o_orderkey % 1000 || chr(10) || 'Order ' || o_orderkey || ' was placed.'
    WHEN o_orderpriority LIKE '3%' THEN 'Panel ' || o_orderkey || ' . ' || o_orderkey % 1000 || chr(10) || 'Order ' || o_orderkey || '   ' || o_orderkey
    ELSE 'Order ' || o_orderkey || ' was placed.' END AS text FROM orders)"""


@query(rf"""WITH {ORDER_PAGES}, blocks AS (SELECT document_id, page, unnest(string_split(text, chr(10) || chr(10))) AS block FROM order_pages),
lines AS (SELECT document_id, page, block, string_split(block, chr(10)) AS l FROM blocks)
SELECT document_id, page, bool_or(len(l) = 1 AND regexp_matches(block, '(?i)^(contents|index|revision|document history)'))
  OR sum(len(list_filter(l, lambda x: regexp_matches(x, '(\.{{2,}}|\s{{2,}})\s*\d{{1,4}}\s*$')))) >= 0.5 * sum(len(l)) AS structural FROM lines GROUP BY 1, 2""")
def structural_pages(spark, sf_dir):
    """Contents pages, dot-leader pages and prose, spelled from orders."""
    o = _read(spark, sf_dir, "orders")
    key, number = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 1000).cast("string")
    prose = F.concat(F.lit("Order "), key, F.lit(" was placed."))
    is_a = lambda n: F.col("o_orderpriority").startswith(n)
    text = (
        F.when(is_a("1"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Contents").otherwise("See contents"), F.lit("\n\n"), prose))
        .when(is_a("2"), F.concat(F.lit("Panel "), key, F.lit(" ........ "), number, F.lit("\n"), prose))
        .when(is_a("3"), F.concat(F.lit("Panel "), key, F.lit(" . "), number, F.lit("\nOrder "), key, F.lit("   "), key))
        .otherwise(prose)
    )
    return cleaning.structural_pages(o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page"), text.alias("text")))


@query(f"WITH {LINES} SELECT normalized, count(*) AS n FROM marked GROUP BY 1")
def normalize_line(spark, sf_dir):
    return cleaning.page_lines(pages_of(spark, sf_dir)).groupBy("normalized").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT o_orderkey, regexp_matches(CASE o_orderkey % 4 WHEN 0 THEN 'Wiring ... ' WHEN 1 THEN 'Zones   ' WHEN 2 THEN 'Zones ' ELSE 'Pages  ' END || o_orderkey % 20000, '(\.{2,}|\s{2,})\s*\d{1,4}\s*$') AS is_toc FROM orders""")
def toc_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    start = F.when(k % 4 == 0, "Wiring ... ").when(k % 4 == 1, "Zones   ").when(k % 4 == 2, "Zones ").otherwise("Pages  ")
    return _read(spark, sf_dir, "orders").select(k, T.is_toc_line(F.concat(start, (k % 20000).cast("string"))).alias("is_toc"))


SINGLE = r"""raw AS (
  SELECT doc_id, regexp_replace(l, '^\s+|\s+$', '', 'g') AS block, n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(l) <> ''),
typed AS (
  SELECT *, CASE WHEN regexp_matches(block, '^\s*\d+[.)]\s+\S') THEN 'procedure'
    WHEN length(block) <= 80 AND NOT regexp_matches(block, '[.,;:]$') AND NOT regexp_matches(block, '^\*\*[^*\n]+:\*\*') THEN 'heading' ELSE 'text' END AS kind,
    greatest(1, length(block) // 4) AS tokens FROM raw),
sections AS (
  SELECT *, last_value(CASE WHEN kind = 'heading' THEN block END IGNORE NULLS) OVER w AS section,
    coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {SINGLE} SELECT kind, count(*) AS n, sum(tokens) AS tokens FROM typed GROUP BY 1")
def block_kinds(spark, sf_dir):
    return chunking.typed_blocks(single_pages(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {LINES}, shaped AS (
  SELECT document_id, page, lower(regexp_replace(regexp_replace(line, '^[#*\\s]+|[#*\\s]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS heading FROM lines
  WHERE length(line) <= 80 AND NOT regexp_matches(line, '[.,;:]$') AND NOT regexp_matches(line, '^\\*\\*[^*\\n]+:\\*\\*'))
SELECT document_id, heading, count(DISTINCT page) AS pages FROM shaped GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""")
def repeated_headings(spark, sf_dir):
    return chunking.repeated_headings(cleaning.page_blocks(pages_of(spark, sf_dir)), least_pages=2)


@query(f"WITH {SINGLE} SELECT doc_id AS document_id, count(*) AS blocks, count(section) AS in_section, count(DISTINCT section) AS sections FROM sections GROUP BY 1")
def heading_section(spark, sf_dir):
    blocks = chunking.with_sections(chunking.typed_blocks(single_pages(spark, sf_dir)))
    return blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("section").alias("in_section"), F.countDistinct("section").alias("sections"))


def _steps(spark, sf_dir):
    """Pages of numbered steps from line items, a table row page after each order's steps."""
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    steps = F.array_join(F.transform("x", lambda i: F.concat(i["l_linenumber"].cast("string"), F.lit(". fit part "), i["l_partkey"].cast("string"))), "\n\n")
    prose = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" is complete."))
    text = F.when(F.col("l_orderkey") % 2 == 0, F.concat(steps, F.lit("\n\n"), prose)).otherwise(steps)
    return items.select((F.col("l_orderkey") % 100).alias("document_id"), F.col("l_orderkey").alias("page"), text.alias("text"))


@query("""WITH items AS (SELECT l_orderkey % 100 AS document_id, l_orderkey AS page, list((l_linenumber || '. fit part ' || l_partkey) ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1, 2),
blocks AS (
  SELECT document_id, page, i AS pos, x[i] AS block, 'procedure' AS kind FROM items, unnest(range(1, len(x) + 1)) t(i)
  UNION ALL SELECT document_id, page, len(x) + 1, 'Order ' || page || ' is complete.', 'text' FROM items WHERE page % 2 = 0),
fresh AS (SELECT *, CASE WHEN kind = 'procedure' AND lag(kind) OVER (PARTITION BY document_id ORDER BY page, pos) = kind THEN 0 ELSE 1 END AS f FROM blocks),
islands AS (SELECT *, sum(f) OVER (PARTITION BY document_id ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS island FROM fresh)
SELECT document_id, min(page) AS page, max(page) AS page_end, any_value(kind) AS kind, string_agg(block, chr(10) ORDER BY page, pos) AS block FROM islands GROUP BY document_id, island""")
def merged_blocks(spark, sf_dir):
    return chunking.merge_atomic(chunking.typed_blocks(_steps(spark, sf_dir))).select("document_id", "page", "page_end", "kind", "block")


def _packed_sql(most: int, overlap: int) -> str:
    return f"""{SINGLE},
docs AS (SELECT doc_id, list({{'block': block, 'kind': kind, 'tokens': tokens, 'section': section, 'before': before}} ORDER BY n) AS b FROM sections GROUP BY 1),
{_spans_sql(most, overlap)},
packed AS (
  SELECT doc_id AS document_id, i - 1 AS chunk_index, array_to_string(list_transform(b[out[i].f:out[i].l], lambda y: y.block), chr(10) || chr(10)) AS content, b[out[i].s].section AS section
  FROM chunks, unnest(range(1, len(out) + 1)) t(i))"""


def _spans_sql(most: int, overlap: int) -> str:
    """From docs (doc_id, b: blocks in order) to chunks (doc_id, b, out: first, last and opening block of each chunk)."""
    return f"""spans AS (SELECT doc_id, b, list_reduce(
  list_transform(range(1, len(b) + 1), lambda i: {{'first': i, 'at': i, 'section_at': i, 'out': []::STRUCT(f BIGINT, l BIGINT, s BIGINT)[]}}),
  lambda acc, x: CASE
    WHEN b[x.at].kind = 'procedure' AND b[x.at].tokens > {most} THEN {{'first': x.at + 1, 'at': x.at, 'section_at': x.at, 'out': list_concat(acc.out,
        CASE WHEN acc.first < x.at THEN [{{'f': acc.first, 'l': x.at - 1, 's': acc.section_at}}] ELSE [] END, [{{'f': x.at, 'l': x.at, 's': x.at}}])}}
    WHEN acc.first < x.at AND b[x.at].before - b[acc.first].before + b[x.at].tokens > {most} THEN {{
        'first': coalesce(list_max(list_filter(range(acc.first, x.at), lambda s: b[x.at].before - b[s].before >= {overlap})), acc.first),
        'at': x.at, 'section_at': x.at, 'out': list_append(acc.out, {{'f': acc.first, 'l': x.at - 1, 's': acc.section_at}})}}
    ELSE {{'first': CASE WHEN acc.first < x.at THEN acc.first ELSE x.at END, 'at': x.at, 'section_at': CASE WHEN acc.first < x.at THEN acc.section_at ELSE x.at END, 'out': acc.out}} END,
  {{'first': 1::BIGINT, 'at': 0::BIGINT, 'section_at': 1::BIGINT, 'out': []::STRUCT(f BIGINT, l BIGINT, s BIGINT)[]}}) AS acc FROM docs),
chunks AS (SELECT doc_id, b, list_concat(acc.out, CASE WHEN acc.first <= len(b) THEN [{{'f': acc.first, 'l': len(b), 's': acc.section_at}}] ELSE [] END) AS out FROM spans)"""


PACKED = _packed_sql(1000, 100)


@query(f"WITH {PACKED} SELECT *, greatest(1, length(content) // 4) AS token_count FROM packed")
def packed_chunks(spark, sf_dir):
    blocks = chunking.with_sections(chunking.merge_atomic(chunking.typed_blocks(single_pages(spark, sf_dir))))
    return chunking.pack(blocks).select("document_id", "chunk_index", "content", "section", "token_count")


@query(f"""WITH {_packed_sql(120, 20)},
lists AS (SELECT document_id, list({{'content': content, 'section': section, 't': greatest(1, length(content) // 4)}} ORDER BY chunk_index) AS c FROM packed GROUP BY 1),
folded AS (SELECT document_id, c, list_reduce(
  list_transform(range(1, len(c) + 1), lambda i: {{'at': i, 'out': []::STRUCT(f BIGINT, l BIGINT, chars BIGINT, kind VARCHAR, section VARCHAR)[]}}),
  lambda acc, x: CASE WHEN c[x.at].t < 50 AND len(acc.out) > 0 AND acc.out[len(acc.out)].section IS NOT DISTINCT FROM c[x.at].section
    THEN {{'at': x.at, 'out': list_append(acc.out[1:len(acc.out) - 1], {{'f': acc.out[len(acc.out)].f, 'l': x.at, 'chars': acc.out[len(acc.out)].chars + 2 + length(c[x.at].content),
      'kind': CASE WHEN (acc.out[len(acc.out)].chars + 2 + length(c[x.at].content)) // 4 < 50 THEN acc.out[len(acc.out)].kind END, 'section': acc.out[len(acc.out)].section}})}}
    ELSE {{'at': x.at, 'out': list_append(acc.out, {{'f': x.at, 'l': x.at, 'chars': length(c[x.at].content), 'kind': CASE WHEN c[x.at].t < 50 THEN 'runt' END, 'section': c[x.at].section}})}} END,
  {{'at': 0::BIGINT, 'out': []::STRUCT(f BIGINT, l BIGINT, chars BIGINT, kind VARCHAR, section VARCHAR)[]}}).out AS out FROM lists)
SELECT document_id, i - 1 AS chunk_index, array_to_string(list_transform(c[out[i].f:out[i].l], lambda y: y.content), chr(10) || chr(10)) AS content, out[i].section AS section,
  greatest(1, out[i].chars // 4) AS token_count, out[i].kind AS section_type FROM folded, unnest(range(1, len(out) + 1)) t(i)""")
def runt_chunks(spark, sf_dir):
    out = chunking.chunk_documents(single_pages(spark, sf_dir), most=120, overlap=20)
    return out.select("document_id", "chunk_index", "content", "section", "token_count", "section_type")


@query(f"WITH {PACKED} SELECT document_id, count(*) AS n_chunks, sum(greatest(1, length(content) // 4)) AS tokens, count(*) FILTER (length(content) // 4 < 50) AS short FROM packed GROUP BY 1")
def chunk_rollup(spark, sf_dir):
    chunks = packed_chunks(spark, sf_dir)
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"), F.count_if(F.col("token_count") < 50).alias("short"))


#: Lines of the multi-page documents.
MULTI_LINES = rf"""every_line AS (
  SELECT document_id, page, regexp_replace(l, '^\s+|\s+$', '', 'g') AS block, l, n FROM (
    SELECT source || '/' || (doc_id // {DOCUMENT_SPAN}) AS document_id, doc_id AS page, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(l) <> '')"""
#: Their blocks, from raw lines: headings on three pages are text, procedures run on across pages.
MULTI = r"""shaped AS (
  SELECT *, CASE WHEN length(block) <= 80 AND NOT regexp_matches(block, '[.,;:]$') AND NOT regexp_matches(block, '^\*\*[^*\n]+:\*\*')
    THEN lower(regexp_replace(regexp_replace(block, '^[#*\s]+|[#*\s]+$', '', 'g'), '^\s+|\s+$', '', 'g')) END AS heading FROM raw),
again AS (SELECT document_id, heading FROM shaped WHERE heading IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3),
typed AS (
  SELECT s.document_id, page, n, block, structural, CASE WHEN regexp_matches(block, '^\s*\d+[.)]\s+\S') THEN 'procedure' WHEN s.heading IS NOT NULL AND a.heading IS NULL THEN 'heading' ELSE 'text' END AS kind
  FROM shaped s LEFT JOIN again a ON a.document_id = s.document_id AND a.heading = s.heading),
islands AS (
  SELECT *, sum(CASE WHEN kind = 'procedure' AND prev = kind THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY page, n) AS prev FROM typed)),
merged AS (SELECT document_id, island, any_value(kind) AS kind, string_agg(block, chr(10) ORDER BY page, n) AS block, min(page) AS page, max(page) AS page_end, bool_or(structural) AS structural FROM islands GROUP BY 1, 2),
numbered AS (SELECT *, greatest(1, length(block) // 4) AS tokens, row_number() OVER w AS i, last_value(CASE WHEN kind = 'heading' THEN block END IGNORE NULLS) OVER w AS section FROM merged
  WINDOW w AS (PARTITION BY document_id ORDER BY island ROWS UNBOUNDED PRECEDING)),
blocks AS (SELECT *, sum(tokens) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - tokens AS before FROM numbered)"""


def _multi_chunks_sql(most: int, overlap: int, least: int) -> str:
    """Chunks one after the other from each document's first block, then islands of short ones."""
    alone = f"kind = 'procedure' AND tokens > {most}"
    return f"""{MULTI},
chain AS (
  SELECT document_id, i AS opener, i AS first, before FROM blocks WHERE i = 1
  UNION ALL
  SELECT * FROM (
    WITH ends AS (
      SELECT c.document_id, c.opener, c.first, o.kind = 'procedure' AND o.tokens > {most} AS was_alone,
        (SELECT min(b.i) FROM blocks b WHERE b.document_id = c.document_id AND b.i > c.opener
          AND (o.kind = 'procedure' AND o.tokens > {most} OR b.{alone.replace(" tokens", " b.tokens")} OR b.before + b.tokens - c.before > {most})) AS next
      FROM chain c JOIN blocks o ON o.document_id = c.document_id AND o.i = c.opener)
    SELECT e.document_id, e.next, t.i, t.before FROM ends e
    JOIN blocks n ON n.document_id = e.document_id AND n.i = e.next
    JOIN blocks t ON t.document_id = e.document_id AND t.i = CASE WHEN e.was_alone OR n.{alone.replace(" tokens", " n.tokens")} THEN e.next
      ELSE coalesce((SELECT max(s.i) FROM blocks s WHERE s.document_id = e.document_id AND s.i >= e.first AND s.i < e.next AND n.before - s.before >= {overlap}), e.first) END)),
spans AS (
  SELECT document_id, opener, first, coalesce(lead(opener) OVER w - 1, (SELECT max(i) FROM blocks b WHERE b.document_id = chain.document_id)) AS last, row_number() OVER w - 1 AS chunk_index
  FROM chain WINDOW w AS (PARTITION BY document_id ORDER BY opener)),
packed AS (
  SELECT s.document_id, chunk_index, string_agg(block, chr(10) || chr(10) ORDER BY i) AS content, min(page) AS page_start, max(page_end) AS page_end, max(CASE WHEN i = opener THEN section END) AS section, bool_or(structural) AS structural
  FROM spans s JOIN blocks b ON b.document_id = s.document_id AND b.i BETWEEN s.first AND s.last GROUP BY 1, 2),
joined AS (
  SELECT *, CASE WHEN chunk_index > 0 AND greatest(1, length(content) // 4) < {least} AND lag(section) OVER w IS NOT DISTINCT FROM section AND NOT structural AND NOT lag(structural) OVER w THEN 0 ELSE 1 END AS fresh
  FROM packed WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS run FROM joined),
final AS (SELECT document_id, CAST(run - 1 AS INT) AS chunk_index, string_agg(content, chr(10) || chr(10) ORDER BY r.chunk_index) AS content, min(page_start) AS page_start, max(page_end) AS page_end, arg_min(struct_pack(s := section), r.chunk_index).s AS section, bool_or(structural) AS structural
  FROM runs r GROUP BY document_id, run),
chunks AS (SELECT *, greatest(1, length(content) // 4) AS token_count, CASE WHEN structural THEN 'structural' WHEN greatest(1, length(content) // 4) < {least} THEN 'runt' END AS section_type FROM final)"""


@query(f"""WITH RECURSIVE {MULTI_LINES}, raw AS (SELECT *, false AS structural FROM every_line), {_multi_chunks_sql(120, 20, 50)}
SELECT document_id, chunk_index, content, page_start, page_end, section, 'text' AS extraction_path, token_count, section_type FROM chunks""")
def document_chunks(spark, sf_dir):
    """Chunks of multi-page documents: repeated headings are text, sections and packing run across pages."""
    return chunking.chunk_documents(bounded_documents(spark, sf_dir), most=120, overlap=20)


@query("SELECT c_nationkey AS nation, count(*) >= 12 AS dense FROM customer GROUP BY 1")
def table_dense_pages(spark, sf_dir):
    """A page of customer names per nation: short lines, dense from 12 on."""
    rows = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(F.collect_list(F.col("c_name")), "\n").alias("text"))
    return rows.select("nation", T.is_table_dense(F.col("text")).alias("dense"))


@query(r"""SELECT doc_id AS page_id, CASE WHEN length(trim(text)) < 50 THEN doc_id % 2 = 0
  ELSE len(l) >= 12 AND len(list_filter(l, lambda x: length(trim(x)) <= 20)) >= 0.65 * len(l) END AS vision
FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)""")
def page_triage(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    figures = docs.select("page_id", (F.col("page_id") % 2 == 1).alias("blank"), F.lit(False).alias("flat"))
    return triage.triage(docs, figures).select("page_id", (F.col("extraction_path") == "vision").alias("vision"))


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN plain = '' THEN 'same row' ELSE plain || chr(10) || chr(10) || 'same row' END
  WHEN 1 THEN text || repeat(chr(10) || chr(10) || 'same row', 2) || chr(10) || chr(10) || 'end' ELSE text END AS cut
FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS plain FROM documents)""")
def repetition_truncate(spark, sf_dir):
    """A loop of one row behind every document, which is one paragraph."""
    return _cut_loops(_read(spark, sf_dir, "documents"))


def _cut_loops(docs):
    copies = F.when(F.col("doc_id") % 3 == 0, 4).when(F.col("doc_id") % 3 == 1, 2).otherwise(0)
    looped = F.concat("text", F.repeat(F.lit("\n\nsame row"), copies), F.when(copies > 0, "\n\nend").otherwise(""))
    return docs.select("doc_id", T.cut_repetition(looped).alias("cut"))


@query(r"""WITH looped AS (
  SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || CASE doc_id % 3 WHEN 0 THEN repeat(chr(10) || chr(10) || 'same row', 4) || chr(10) || chr(10) || 'end'
    WHEN 1 THEN repeat(chr(10) || chr(10) || 'same row', 2) || chr(10) || chr(10) || 'end' ELSE '' END AS text FROM documents),
parts AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM looped),
same AS (SELECT *, list_transform(p, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS q FROM parts),
hits AS (
  SELECT doc_id, min({'first': a, 'period': k}) AS hit FROM (SELECT doc_id, q, unnest(range(1, len(q) + 1)) AS a FROM same), (VALUES (1), (2), (3)) periods(k)
  WHERE a + 3 * k - 1 <= len(q) AND q[a:a + 2 * k - 1] = q[a + k:a + 3 * k - 1] GROUP BY 1)
SELECT s.doc_id, CASE WHEN hit IS NULL THEN text ELSE array_to_string(p[1:hit.first + hit.period - 1], chr(10) || chr(10)) END AS cut FROM same s LEFT JOIN hits h ON h.doc_id = s.doc_id""")
def repetition_truncate_all(spark, sf_dir):
    """Repetitions cut in every document, each line a paragraph; a null text stays null."""
    docs = _read(spark, sf_dir, "documents")
    return _cut_loops(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("""SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS manufacturer, CASE WHEN c_custkey % 2 = 0 THEN 'datasheet' ELSE 'other' END AS doc_type, c_name AS revision FROM customer""")
def metadata_parse(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    name = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment"))
    body = F.to_json(F.struct(name.alias("manufacturer"), F.when(F.col("c_custkey") % 2 == 0, "datasheet").otherwise("poem").alias("doc_type"), F.col("c_name").alias("revision")))
    reply = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    return c.select("c_custkey", T.parse_metadata(reply).alias("x")).select("c_custkey", "x.manufacturer", "x.doc_type", "x.revision")


def _files(spark, sf_dir):
    """Documents as files; those with an id divisible by 17 can't be read."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/inbox/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf"))
    content = F.when(F.col("doc_id") % 17 > 0, F.encode("text", "utf-8"))
    return docs.select("doc_id", path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), F.sha2(content, 256).alias("file_hash"), content.alias("content"))


def _known(spark, sf_dir):
    return _files(spark, sf_dir).where("doc_id % 7 = 1 and file_hash is not null").select("file_hash").distinct()


FILES = """files AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') || '.pdf' AS file_name, CASE WHEN doc_id % 17 > 0 THEN sha256(text) END AS h FROM documents),
known AS (SELECT DISTINCT h FROM files WHERE doc_id % 7 = 1 AND h IS NOT NULL),
judged AS (SELECT *, h IS NOT NULL AND (h IN (SELECT h FROM known) OR row_number() OVER (PARTITION BY h ORDER BY file_name) > 1) AS duplicate, h IS NULL AS failed FROM files)"""


@query(f"WITH {FILES} SELECT h AS document_id, file_name, h AS file_hash, 'queued' AS status FROM judged WHERE NOT duplicate AND NOT failed")
def ingest_dedupe(spark, sf_dir):
    return files.ingest(_files(spark, sf_dir), _known(spark, sf_dir))[0]


@query(f"WITH {FILES} SELECT count(*) FILTER (NOT duplicate AND NOT failed) AS ingested, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (failed) AS failed, count(*) AS total FROM judged")
def ingest_tallies(spark, sf_dir):
    return files.ingest(_files(spark, sf_dir), _known(spark, sf_dir))[1]


@query(f"WITH {FILES} SELECT '/inbox/' || file_name AS path, file_name, h AS document_id, duplicate, failed FROM judged")
def ingest_files(spark, sf_dir):
    return files.ingest_results(_files(spark, sf_dir), _known(spark, sf_dir))


@query(f"WITH {FILES} SELECT h AS file_hash, any_value(octet_length(encode(text))) AS bytes FROM files JOIN documents USING (doc_id) WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM known) GROUP BY 1")
def store_contents(spark, sf_dir):
    return files.store_files(_files(spark, sf_dir), _known(spark, sf_dir)).select("file_hash", F.octet_length("content").cast("long").alias("bytes"))


ELIGIBLE = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 20 = 0)"
KNN = f"""{ELIGIBLE}, pairs AS (SELECT a.vec_id AS chunk_id, b.vec_id AS neighbor_id, list_cosine_similarity(a.v, b.v) AS similarity FROM e a, e b WHERE a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, neighbor_id) AS r FROM pairs),
directed AS (SELECT chunk_id, neighbor_id, similarity FROM ranked WHERE r <= 5 AND similarity >= 0.35),
edges AS (SELECT least(chunk_id, neighbor_id) AS source, greatest(chunk_id, neighbor_id) AS target, max(similarity) AS similarity FROM directed GROUP BY 1, 2)"""


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 20 = 0")
def retrieval_eligible(spark, sf_dir):
    return vectors.retrievable(chunks_of(spark, sf_dir)).select("chunk_id")


@query(f"WITH {ELIGIBLE} SELECT vec_id AS chunk_id, round(list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM e ORDER BY list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 40")
def search_chunks(spark, sf_dir):
    chunks = chunks_of(spark, sf_dir)
    first = chunks.where("chunk_id = 0").select("embedding").first()
    return vectors.search(chunks, first.embedding).withColumn("similarity", F.round("similarity", 6))


def _edges(spark, sf_dir):
    return materialize(graph.undirected(vectors.knn_edges(chunks_of(spark, sf_dir), threshold=0.35)), "edges")


@query(f"WITH {KNN} SELECT chunk_id, neighbor_id, round(similarity, 6) AS similarity FROM directed")
def knn_edges(spark, sf_dir):
    return vectors.knn_edges(chunks_of(spark, sf_dir), threshold=0.35).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {KNN} SELECT source, target, round(similarity, 6) AS similarity FROM edges")
def undirected_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {KNN} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1")
def node_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


COMPONENTS = KNN.replace("e AS (", "RECURSIVE e AS (", 1) + """, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)"""


def _components(spark, sf_dir, edges=None):
    nodes = chunks_of(spark, sf_dir).select(F.col("chunk_id").alias("node"))
    return graph.components_of(nodes, _edges(spark, sf_dir) if edges is None else edges)


@query(f"WITH {COMPONENTS} SELECT * FROM components")
def components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"WITH {COMPONENTS} SELECT * FROM components WHERE node IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def components_by_batch(spark, sf_dir):
    """The graph's edges added in three batches to components that are kept."""
    edges = _edges(spark, sf_dir)
    kept = ComponentStore(spark, _stream_folder(spark))
    for number in range(3):
        kept.add(edges.where((F.col("source") + F.col("target")) % 3 == number), number)
    return kept.labels()


@query(f"WITH {COMPONENTS} SELECT component, count(*) AS members FROM components GROUP BY 1 HAVING count(*) >= 2")
def cluster_sizes(spark, sf_dir):
    return graph.cluster_sizes(_components(spark, sf_dir))


@query(f"""WITH {KNN} SELECT least(x.label, y.label) AS doc_a, greatest(x.label, y.label) AS doc_b, count(*) AS links, round(avg(similarity), 6) AS similarity
FROM edges JOIN embeddings x ON x.vec_id = source JOIN embeddings y ON y.vec_id = target WHERE x.label <> y.label GROUP BY 1, 2""")
def document_graph(spark, sf_dir):
    owners = chunks_of(spark, sf_dir).select(F.col("chunk_id").alias("node"), "document")
    return graph.document_graph(_edges(spark, sf_dir), owners).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {KNN}, hub AS (SELECT min(source) AS hub FROM edges) SELECT CASE WHEN source = hub THEN target ELSE source END AS neighbor, round(similarity, 6) AS similarity FROM edges, hub WHERE hub IN (source, target)")
def neighbours(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.neighbours(edges, edges.agg(F.min("source")).first()[0]).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {KNN}, degree AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1),
hits AS (SELECT vec_id FROM e ORDER BY list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 40)
SELECT b.vec_id AS node, coalesce(degree, 0) AS degree, h.vec_id IS NOT NULL AS matched,
  CASE WHEN h.vec_id IS NOT NULL THEN greatest(1, coalesce(degree, 0)) + 3.0::DOUBLE ELSE greatest(0.5::DOUBLE, 0.4::DOUBLE * greatest(1, coalesce(degree, 0))) END AS value
FROM embeddings b LEFT JOIN degree ON node = b.vec_id LEFT JOIN hits h ON h.vec_id = b.vec_id""")
def search_highlight(spark, sf_dir):
    nodes = chunks_of(spark, sf_dir).select(F.col("chunk_id").alias("node"))
    return graph.highlight(nodes, _edges(spark, sf_dir), search_chunks(spark, sf_dir))


def _flag_tables(spark, sf_dir):
    s, d = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "documents")
    k = F.col("c_custkey")
    documents = s.select(
        k.alias("document_id"), F.when(k % 4 == 0, "queued").when(k % 4 == 1, "review").otherwise("done").alias("status"), (k % 3 * 10).alias("page_count"),
        F.when(k % 7 == 0, "stopped").alias("cleaning_warning"), F.when(k % 5 == 0, F.concat("c_name", F.lit(" (see cover)"))).otherwise(F.col("c_name")).alias("manufacturer"),
        F.when(k % 6 == 0, F.repeat(F.col("c_name"), F.lit(3))).alias("revision"), F.when(k % 8 > 0, "other").alias("doc_type"), F.when(k % 4 == 0, "late").alias("error_message"),
    )
    chunks = d.select(
        (F.col("doc_id") % 100).alias("document_id"), F.col("doc_id").alias("chunk_id"), T.estimate_tokens(F.col("text")).alias("token_count"), F.when(F.col("doc_id") % 9 == 0, "runt").alias("section_type"),
        F.when(F.col("doc_id") % 100 % 3 == 0, "vision").otherwise("text").alias("extraction_path"), F.when(F.col("doc_id") % 11 == 0, "true").alias("retrieval_override"),
    )
    return documents, chunks


FLAGS = """stats AS (
  SELECT doc_id % 100 AS document_id, count(*) AS n_chunks, sum(greatest(1, length(text) // 4)) AS tokens, count(*) FILTER (greatest(1, length(text) // 4) < 15 AND doc_id % 9 <> 0) AS short_chunks,
    count(*) FILTER (doc_id % 100 % 3 = 0) AS vision_chunks, bool_or(doc_id % 11 = 0) AS has_override FROM documents GROUP BY 1),
d AS (SELECT c_custkey AS k, c_name, c_custkey % 4 <> 0 AS processed, c_custkey % 3 * 10 AS pages, coalesce(n_chunks, 0) AS n_chunks, tokens, short_chunks, vision_chunks
  FROM customer LEFT JOIN stats ON document_id = c_custkey),
flags AS (SELECT k AS document_id, list_filter([
  CASE WHEN k % 7 = 0 THEN 'cleaning-safety-rail' END, CASE WHEN processed AND pages > 0 AND n_chunks = 0 THEN 'no-chunks' END,
  CASE WHEN processed AND n_chunks > 0 AND pages > 0 AND tokens < 40 * pages THEN 'low-content-density' END, CASE WHEN short_chunks > 0 THEN 'short-chunks' END,
  CASE WHEN n_chunks > 0 AND 2 * vision_chunks > n_chunks THEN 'heavily-vision' END, CASE WHEN k % 5 = 0 THEN 'manufacturer-prose' END,
  CASE WHEN k % 6 = 0 AND length(c_name) * 3 > 40 THEN 'revision-prose' END, CASE WHEN processed AND k % 8 = 0 THEN 'no-doc-type' END], lambda x: x IS NOT NULL) AS f FROM d)"""


@query(f"WITH {FLAGS} SELECT document_id, array_to_string(f, ',') AS keys, len(f) AS n_flags, CASE WHEN list_contains(f, 'cleaning-safety-rail') OR list_contains(f, 'no-chunks') THEN 'critical' WHEN len(f) > 0 THEN 'warning' END AS worst FROM flags")
def doc_flags(spark, sf_dir):
    found = flags.document_flags(*_flag_tables(spark, sf_dir))
    return found.select("document_id", F.array_join("flags.key", ",").alias("keys"), "n_flags", "worst")


@query(f"WITH {FLAGS} SELECT count(*) FILTER (len(f) > 0) AS flagged, count(*) AS documents FROM flags")
def flagged_documents(spark, sf_dir):
    found = flags.document_flags(*_flag_tables(spark, sf_dir))
    return found.agg(F.count_if(F.col("n_flags") > 0).alias("flagged"), F.count(F.lit(1)).alias("documents"))


@query(f"WITH {FLAGS} SELECT * FROM stats")
def queue_stats(spark, sf_dir):
    return flags.chunk_stats(_flag_tables(spark, sf_dir)[1])


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 9 = 0 AND doc_id % 11 <> 0 THEN 'excluded' WHEN length(text) // 4 < 15 THEN 'flagged' ELSE 'normal' END AS state,
  length(text) // 4 < 15 AND NOT (doc_id % 9 = 0 AND doc_id % 11 <> 0) AS short_badge FROM documents""")
def chunk_states(spark, sf_dir):
    return views.chunk_states(_flag_tables(spark, sf_dir)[1])


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 9 = 0 AND doc_id % 11 <> 0")
def excluded_chunks(spark, sf_dir):
    return views.excluded(_flag_tables(spark, sf_dir)[1]).select("chunk_id")


@query("SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'busy' ELSE 'ok' END AS verdict FROM customer UNION ALL SELECT -1, 'missing'")
def reprocess_guard(spark, sf_dir):
    documents, _ = _flag_tables(spark, sf_dir)
    busy = documents.withColumn("status", F.when(F.col("status") == "queued", "chunking").otherwise(F.col("status")))
    none = documents.limit(1).select((F.col("document_id") * 0 - 1).alias("document_id"))
    return views.may_reprocess(busy, documents.select("document_id").unionByName(none))


@query(f"""WITH {KNN}, hits AS (SELECT vec_id FROM e ORDER BY list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 40)
SELECT source, target, round(greatest(0.5::DOUBLE, 8 * (similarity - 0.7::DOUBLE)), 6) AS width, source IN (SELECT vec_id FROM hits) OR target IN (SELECT vec_id FROM hits) AS lit FROM edges""")
def graph_links(spark, sf_dir):
    return views.lit_links(_edges(spark, sf_dir), search_chunks(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query("SELECT c_custkey AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 'embedding' WHEN c_custkey % 4 = 1 THEN 'review' ELSE 'done' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'late' END AS error_message FROM customer")
def status_overlay(spark, sf_dir):
    documents, _ = _flag_tables(spark, sf_dir)
    live = documents.where("document_id % 2 = 0").select("document_id", F.lit("embedding").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return flags.status_overlay(documents, live)


@query("SELECT c_custkey AS document_id, count(o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def cascade_delete(spark, sf_dir):
    customers, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    tables = {"documents": customers.withColumnRenamed("c_custkey", "document_id"), "chunks": orders.withColumnRenamed("o_custkey", "document_id")}
    left = store.delete_documents(tables, tables["documents"].where("c_mktsegment = 'BUILDING'"))
    return left["documents"].select("document_id").join(left["chunks"], "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'true' WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 2 = 1 THEN 'old' END AS override, source FROM documents")
def override_toggle(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    meta = F.when(F.col("doc_id") % 2 == 1, F.create_map(F.lit("retrieval_override"), F.lit("old"), F.lit("source"), F.col("source"))).otherwise(F.create_map(F.lit("source"), F.col("source")))
    chunks = docs.select("doc_id", meta.alias("metadata"))
    on = store.retrieval_override(chunks, F.col("doc_id") % 4 == 0, True)
    off = store.retrieval_override(on, F.col("doc_id") % 4 == 1, False)
    return off.select("doc_id", F.try_element_at("metadata", F.lit("retrieval_override")).alias("override"), F.try_element_at("metadata", F.lit("source")).alias("source"))


@query("SELECT 'user-' || user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS version FROM events GROUP BY 1")
def settings_upsert(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("version"))
    return store.upsert_settings(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 4 ELSE 3 END AS stage, count(*) AS n FROM orders GROUP BY 1")
def stage_progress(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("embedding")
    return _read(spark, sf_dir, "orders").groupBy(T.stage_index(status).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'Section ' || label ELSE 'Chunk #' || vec_id END || ' (p.' || CASE WHEN vec_id % 4 = 0 THEN '?' ELSE (vec_id % 10)::VARCHAR END || ')' AS label,
  'p.' || vec_id % 10 || CASE WHEN vec_id % 2 = 0 THEN '–' || (vec_id % 10 + 1) ELSE '' END AS pages, CAST(round((vec_id * 137.508::DOUBLE) % 360, 0) AS INT) AS hue FROM embeddings""")
def chunk_labels(spark, sf_dir):
    c, i = chunks_of(spark, sf_dir), F.col("chunk_id")
    section = F.when(i % 3 == 0, F.concat(F.lit("Section "), F.col("document").cast("string")))
    return c.select("chunk_id", T.chunk_label(section, i, F.when(i % 4 != 0, i % 10)).alias("label"), T.page_range(i % 10, i % 10 + (i + 1) % 2).alias("pages"), T.hue(i).alias("hue"))


@query("""WITH px AS (SELECT label AS page_id, i - 1 AS x, vec_id % 50 AS y, CAST(floor(least(255, greatest(0, 128 + 400 * embedding[i]::DOUBLE))) AS INT) AS gray FROM embeddings, unnest(range(1, 65)) t(i)),
s AS (SELECT page_id, max(x) + 1 AS w, max(y) + 1 AS h, avg((gray < 250)::INT::DOUBLE) AS ink FROM px GROUP BY 1),
c AS (SELECT page_id, y // (h // 10) AS gy, x // (w // 10) AS gx, stddev_pop(gray) > 12 AS t FROM px JOIN s USING (page_id) WHERE w >= 10 AND h >= 10 GROUP BY 1, 2, 3 HAVING gx < 10 AND gy < 10),
r AS (SELECT page_id, gy, bool_or(t) AS t FROM c GROUP BY 1, 2)
SELECT page_id, round(ink, 6) AS ink, ink < 0.002 AS blank, coalesce(f, false) AS flat FROM s LEFT JOIN (SELECT page_id, avg(t::INT::DOUBLE) < 0.3 AS f FROM r GROUP BY 1) USING (page_id)""")
def flat_graphic_grid(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("page_id"), (F.col("vec_id") % 50).alias("y"), F.posexplode("embedding").alias("x", "v"))
    gray = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 400 * F.col("v").cast("double")))).cast("int")
    return triage.pixel_figures(v.select("page_id", "x", "y", gray.alias("gray"))).withColumn("ink", F.round("ink", 6))


@query("""WITH page AS (
  SELECT doc_id AS page_id, 16 + doc_id % 5 AS w, CASE WHEN doc_id % 7 = 0 THEN repeat('FF', strlen(text)) ELSE hex(encode(text)) END AS bytes, strlen(text) // 20 AS h FROM documents),
px AS (SELECT page_id, w, h, i // 20 AS y, i % 20 AS x, ('0x' || substr(bytes, 2 * i + 1, 2))::INT AS gray FROM page, unnest(range(h * 20)) t(i) WHERE i % 20 < w),
ink AS (SELECT page_id, avg((gray < 250)::INT::DOUBLE) AS ink FROM px GROUP BY 1),
c AS (SELECT page_id, y // greatest(1, h // 10) AS gy, x // greatest(1, w // 10) AS gx, stddev_pop(gray) > 12 AS t FROM px WHERE w >= 10 AND h >= 10 GROUP BY 1, 2, 3 HAVING gx < 10 AND gy < 10),
r AS (SELECT page_id, gy, bool_or(t) AS t FROM c GROUP BY 1, 2),
f AS (SELECT page_id, avg(t::INT::DOUBLE) < 0.3 AS flat FROM r GROUP BY 1)
SELECT page_id, round(ink, 6) AS ink, ink IS NULL OR ink < 0.002 AS blank, coalesce(flat, false) AS flat FROM page LEFT JOIN ink USING (page_id) LEFT JOIN f USING (page_id)""")
def raster_pages(spark, sf_dir):
    """Every document's bytes as the gray samples of a page with rows of 20 bytes, of which 16 to 20 are shown; some pages are white."""
    docs = _read(spark, sf_dir, "documents")
    samples = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.repeat(F.lit("FF"), F.octet_length("text")))).otherwise(F.encode("text", "utf-8"))
    pages = docs.select(F.col("doc_id").alias("page_id"), samples.alias("samples"), (16 + F.col("doc_id") % 5).cast("int").alias("width"), F.floor(F.octet_length("text") / 20).cast("int").alias("height"), F.lit(20).alias("stride"))
    return triage.raster_figures(pages).withColumn("ink", F.round("ink", 6))


class CountingProvider:
    """Offline: the figures of a text as its vector, so that SQL can tell them too."""

    def embed(self, texts):
        return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]

    def complete(self, prompt):
        """The length of the prompt as a revision; every fifth prompt gets no object."""
        return "no idea" if len(prompt) % 5 == 0 else f'{{"doc_type": "datasheet", "revision": "{len(prompt)}"}}'

    def transcribe(self, image, prompt):
        """A loop, a blank page, or the number of bytes."""
        n = len(image)
        return ["again\n\n" * 5 + "end", "NO_CONTENT", f"{n} bytes"][n % 3]


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE length(text) END::DOUBLE AS chars, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE length(text) - length(replace(text, ' ', '')) END::DOUBLE AS spaces,
  CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE length(text) - length(replace(text, chr(10), '')) END::DOUBLE AS breaks FROM documents""")
def embed_pending(spark, sf_dir):
    """Vectors of every document's text; those with an even id have one already."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    known = F.when(F.col("chunk_id") % 2 == 0, F.array_repeat(F.lit(0.5).cast("float"), 3))
    done = vectors.embed_pending(docs.withColumn("embedding", known), CountingProvider())
    return done.select("chunk_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("chars", "spaces", "breaks"))])


class HalfProvider(CountingProvider):
    """Has no answer to texts of an odd length."""

    def embed(self, texts):
        if any(len(t) % 2 for t in texts):
            raise ValueError("odd")
        return super().embed(texts)


class DoublingProvider(CountingProvider):
    """Twice the figures, so that one can tell who was asked."""

    def embed(self, texts):
        return [[2 * x for x in v] for v in super().embed(texts)]


@query("""SELECT doc_id AS chunk_id, (length(text) * (1 + length(text) % 2))::DOUBLE AS chars, length(text) % 2 = 1 AS failed_first FROM documents""")
def embed_resumed(spark, sf_dir):
    """Every document's text embedded in two runs over one store: the second asks for what the first has not got."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/vectors-{uuid.uuid4().hex}"
    first = materialize(vectors.embed_resumable(docs, HalfProvider(), folder, give_up=None), "embed-first").select("chunk_id", F.col("embed_error").isNotNull().alias("failed_first"))
    done = vectors.embed_resumable(docs, DoublingProvider(), folder).select("chunk_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"))
    return done.join(first, "chunk_id")


def _pipeline_sql(lines: str, pages: str) -> str:
    """All stages in SQL: from every_line (document_id, page, block, l, n) and pages (document_id, n) to chunks; furniture on a tenth of the pages."""
    return rf"""{lines},
judged AS (SELECT *, regexp_replace(regexp_replace(block, '\s+', ' ', 'g'), '\d+', '#', 'g') AS normalized, length(block) <= 80 AND NOT regexp_matches(block, '(?i)\b(warning|caution|danger|note:)\b') AS candidate FROM every_line),
need AS (SELECT document_id, greatest(5, CAST(ceil(n * 0.1::DOUBLE) AS INT)) AS need FROM ({pages})),
furniture AS (SELECT document_id, normalized FROM judged JOIN need USING (document_id) WHERE candidate GROUP BY document_id, normalized, need HAVING count(DISTINCT page) >= need),
marked_lines AS (SELECT j.*, j.candidate AND f.normalized IS NOT NULL AS gone FROM judged j LEFT JOIN furniture f ON f.document_id = j.document_id AND f.normalized = j.normalized),
stopped AS (SELECT document_id FROM marked_lines GROUP BY 1 HAVING round(count(*) FILTER (gone) * 100.0::DOUBLE / count(*), 2) > 15),
structural_page AS (SELECT document_id, page FROM every_line GROUP BY 1, 2
  HAVING bool_or(regexp_matches(block, '(?i)^(contents|index|revision|document history)')) OR count(*) FILTER (regexp_matches(l, '(\.{{2,}}|\s{{2,}})\s*\d{{1,4}}\s*$')) >= 0.5 * count(*)),
raw AS (SELECT m.document_id, m.page, block, n, s.page IS NOT NULL AS structural FROM marked_lines m LEFT JOIN structural_page s ON s.document_id = m.document_id AND s.page = m.page
  WHERE NOT gone AND m.document_id NOT IN (FROM stopped)),
{_multi_chunks_sql(1000, 100, 50)}"""


@query(f"""WITH RECURSIVE {_pipeline_sql(MULTI_LINES, f"SELECT source || '/' || (doc_id // {DOCUMENT_SPAN}) AS document_id, count(*) AS n FROM documents GROUP BY 1")}
SELECT sha256(document_id || '|' || chunk_index) AS chunk_id, document_id, chunk_index, token_count, section_type, 64 AS width FROM chunks""")
def document_pipeline(spark, sf_dir):
    """All stages on all pages of multi-page documents: clean, chunk, embed."""
    chunks, _ = DocumentPipeline(HashingProvider(), min_ratio=0.1).run(bounded_documents(spark, sf_dir))
    return chunks.select("chunk_id", "document_id", "chunk_index", "token_count", "section_type", F.size("embedding").alias("width"))


def _file_stream(spark, sf_dir):
    """Documents as a stream of files."""
    ensure_code(spark)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents*.parquet")
    path, content = F.concat(F.lit("/inbox/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf")), F.encode("text", "utf-8")
    return docs.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), F.sha2(content, 256).alias("file_hash"), content.alias("content"))


def _stream_folder(spark):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


@query("SELECT sha256(text) AS file_hash, lpad(min(doc_id)::VARCHAR, 12, '0') || '.pdf' AS file_name FROM documents GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Documents as a file stream; each content is queued once, under the first of its names."""
    out = _stream_folder(spark)
    ingest.ingest_stream(_file_stream(spark, sf_dir), f"{out}/documents", f"{out}/state").awaitTermination()
    return ingest.ingested(spark, f"{out}/documents").select("file_hash", "file_name")


def _ten_line_pages(content: bytes) -> list:
    """Pages of ten lines, every line a paragraph; files of some lengths are broken."""
    if len(content) % 13 == 0:
        raise ValueError("broken")
    lines = content.decode().split("\n")
    return [("\n\n".join(lines[at : at + 10]), True, None) for at in range(0, len(lines), 10)]


WATCHED = r"""names AS (SELECT sha256(text) AS document_id, text, lpad(min(doc_id)::VARCHAR, 12, '0') || '.pdf' AS file_name, strlen(text) % 13 = 0 AS broken FROM documents GROUP BY text),
every_line AS (
  SELECT document_id, (n - 1) // 10 + 1 AS page, regexp_replace(l, '^\s+|\s+$', '', 'g') AS block, l, n FROM (
    SELECT document_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM names WHERE NOT broken) WHERE trim(l) <> '')"""


@query(f"""WITH RECURSIVE {_pipeline_sql(WATCHED, "SELECT document_id, (len(string_split(text, chr(10))) + 9) // 10 AS n FROM names WHERE NOT broken")},
counted AS (SELECT document_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY 1)
SELECT document_id, file_name, CASE WHEN broken THEN 'failed' ELSE 'review' END AS status, CASE WHEN broken THEN 'ValueError: broken' END AS error_message, coalesce(n_chunks, 0) AS n_chunks, coalesce(tokens, 0) AS tokens
FROM names LEFT JOIN counted USING (document_id)""")
def watched_documents(spark, sf_dir):
    """Documents as a stream of files that runs through intake, extraction, cleaning, chunking and embedding; states and chunks of each."""
    out = _stream_folder(spark)
    pipeline = DocumentPipeline(HashingProvider(), min_ratio=0.1)
    ingest.process_stream(_file_stream(spark, sf_dir), f"{out}/store", pipeline, _ten_line_pages, f"{out}/state", ask=False).awaitTermination()
    chunks = ingest.processed(spark, f"{out}/store", "chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))
    found = ingest.processed(spark, f"{out}/store", "documents").join(chunks, "document_id", "left")
    return found.select("document_id", "file_name", "status", "error_message", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def _documents(spark, sf_dir):
    """Sources as documents; those of an even length of name came with an old error."""
    docs = _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("document_id")).agg(F.count(F.lit(1)).alias("page_count"))
    late = F.when(F.length("document_id") % 2 == 0, "late")
    return docs.select("document_id", "page_count", F.lit("queued").alias("status"), late.alias("error_message"), F.lit(None).cast("string").alias("doc_type"), F.create_map().cast("map<string,string>").alias("metadata"))


def _broken(documents):
    """Documents whose file can't be read: those with few pages for their name."""
    return documents.where("page_count % 5 = 0").select("document_id", F.lit("ValueError: broken").alias("error_message"))


@query(f"""WITH {REPORT.removeprefix("WITH ")},
d AS (SELECT source AS document_id, count(*) AS n FROM documents GROUP BY 1)
SELECT document_id, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'review' END AS status, CASE WHEN n % 5 = 0 THEN 'ValueError: broken' END AS error_message,
  n % 5 <> 0 AND stripped_pct > 1 AS warned FROM d LEFT JOIN report USING (document_id)""")
def process_documents(spark, sf_dir):
    """All stages with states: unreadable documents fail, the safety rail stops some, the others end in review."""
    documents = _documents(spark, sf_dir)
    run = DocumentPipeline(CountingProvider(), min_ratio=0.1, rail_pct=1.0).process(documents, pages_of(spark, sf_dir), failures=_broken(documents), ask=False)
    warned = F.try_element_at("metadata", F.lit("cleaning_warning")).isNotNull()
    return run.documents.select("document_id", "status", "error_message", warned.alias("warned"))


@query(f"""WITH {REPORT.removeprefix("WITH ")},
d AS (SELECT source AS document_id, count(*) AS n, length(source) % 2 = 0 AS override FROM documents GROUP BY 1)
SELECT document_id, 'review' AS status, CASE WHEN override THEN 'true' END AS override, stripped_pct > 1 AND NOT override AS warned, override OR stripped_pct <= 1 AS chunked FROM d JOIN report USING (document_id)""")
def proceed_override(spark, sf_dir):
    """Documents that the safety rail has stopped; those of an even length of name are told to proceed and tried again."""
    documents, pages = _documents(spark, sf_dir), pages_of(spark, sf_dir)
    pipeline = DocumentPipeline(CountingProvider(), min_ratio=0.1, rail_pct=1.0)
    first = pipeline.process(documents.where("length(document_id) % 2 = 1"), pages.where("length(document_id) % 2 = 1"), ask=False)
    told = documents.where("length(document_id) % 2 = 0")
    second = pipeline.proceed_anyway(told, told.select("document_id"), pages, ask=False)
    override, warned = F.try_element_at("metadata", F.lit(store.PROCEED)), F.try_element_at("metadata", F.lit("cleaning_warning")).isNotNull()
    chunked = first.chunks.unionByName(second.chunks).select("document_id", F.lit(True).alias("chunked")).distinct()
    done = first.documents.unionByName(second.documents).join(chunked, "document_id", "left")
    return done.select("document_id", "status", override.alias("override"), warned.alias("warned"), F.coalesce("chunked", F.lit(False)).alias("chunked"))


@query(f"""WITH {_furniture_sql('0.1')}, left_over AS (SELECT document_id, normalized FROM furniture WHERE length(normalized) % 2 = 1),
counts AS (SELECT m.document_id, count(*) AS total_lines, count(*) FILTER (candidate AND f.normalized IS NOT NULL) AS stripped_lines FROM marked m LEFT JOIN left_over f USING (document_id, normalized) GROUP BY 1)
SELECT document_id, total_lines, stripped_lines FROM counts""")
def restore_furniture(spark, sf_dir):
    """People restore the furniture lines of even length; their documents are cleaned again without stripping these."""
    pages = pages_of(spark, sf_dir)
    found = cleaning.furniture(pages, min_ratio=0.1)
    old = found.limit(0).select("document_id", "normalized")
    json = files.write_overrides(old.select("document_id", F.lit("[]").alias("json")), found.where("length(normalized) % 2 = 0"))
    again = cleaning.clean(pages, 0.1, overrides=files.read_overrides(json))
    return again.report.select("document_id", "total_lines", "stripped_lines")


@query("""WITH first AS (SELECT source, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3)
SELECT source AS document_id, string_agg(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY doc_id) AS prompt_text FROM first GROUP BY 1""")
def metadata_prompt(spark, sf_dir):
    return files.prompt_text(pages_of(spark, sf_dir))


@query("""WITH first AS (SELECT source, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3),
prompts AS (SELECT source AS document_id, length(string_agg(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY doc_id)) + QUESTION AS n FROM first GROUP BY 1)
SELECT document_id, 'datasheet' AS doc_type, n::VARCHAR AS revision FROM prompts WHERE n % 5 <> 0""".replace("QUESTION", str(len(files.METADATA_QUESTION.format(kinds=", ".join(T.DOC_TYPES))))))
def infer_metadata(spark, sf_dir):
    """What the model says about each document's first pages; replies without an object leave a document as it is."""
    found = DocumentPipeline(CountingProvider()).metadata(_documents(spark, sf_dir), pages_of(spark, sf_dir))
    return found.select("document_id", "doc_type", "revision")


def _extractor(content):
    """Lines as pages; a text of an odd number of bytes that ends in a full stop is no file."""
    if len(content) % 2 and content.endswith(b"."):
        raise ValueError("broken")
    return [(line.decode(), len(line) % 4 == 0, line) for line in content.split(b"\n")]


EXTRACTED = """texts AS (SELECT sha256(text) AS document_id, any_value(text) AS text, max(doc_id % 2) AS odd FROM documents GROUP BY 1),
files AS (SELECT *, octet_length(encode(text)) % 2 = 1 AND text LIKE '%.' AS broken FROM texts),
pages AS (SELECT document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page, odd FROM files WHERE NOT broken)"""


@query(f"""WITH {EXTRACTED}, sized AS (SELECT *, octet_length(encode(text)) AS n FROM pages WHERE page > 1 OR odd = 1)
SELECT document_id, page::INT AS page, CASE WHEN length(trim(text)) < 50 AND n % 4 <> 0 THEN 'vision' ELSE 'text' END AS extraction_path,
  CASE WHEN NOT (length(trim(text)) < 50 AND n % 4 <> 0) THEN text WHEN n % 3 = 0 THEN 'again' WHEN n % 3 = 1 THEN '' ELSE n || ' bytes' END AS text FROM sized""")
def extract_pages(spark, sf_dir):
    """Files to pages: those done are left out, broken files stand aside, short pages with ink are read by the model."""
    docs = _read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_hash"), F.encode("text", "utf-8").alias("content"), (F.col("doc_id") % 2).alias("odd"))
    once = docs.groupBy("file_hash").agg(F.first("content").alias("content"), F.max("odd").alias("odd"))
    done = once.where("odd = 0").select(F.col("file_hash").alias("document_id"), F.lit(1).alias("page"))
    pages, _ = DocumentPipeline(CountingProvider()).extract(once, done, _extractor)
    return pages.select("document_id", "page", "extraction_path", "text")


@query(f"WITH {EXTRACTED} SELECT document_id, 'ValueError: broken' AS error_message FROM files WHERE broken")
def extract_failures(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("file_hash"), F.encode("text", "utf-8").alias("content")).dropDuplicates(["file_hash"])
    done = docs.limit(0).select(F.col("file_hash").alias("document_id"), F.lit(1).alias("page"))
    return files.extract_pages(docs, done, _extractor)[1]


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'vision' ELSE 'text' END AS extraction_path, doc_id % 3 = 0 AS structural, text, CASE WHEN doc_id < 100 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END || '.md' AS name FROM documents""")
def page_files(spark, sf_dir):
    """Pages written with their markers and read back."""
    docs = _read(spark, sf_dir, "documents")
    path, structural = F.when(F.col("lang") == "en", "vision").otherwise("text"), F.col("doc_id") % 3 == 0
    written = docs.select("doc_id", F.when(structural, T.write_page_file(path, F.col("text"), structural)).otherwise(T.write_page_file(path, F.col("text"))).alias("file"))
    return written.select("doc_id", T.read_page_file(F.col("file")).alias("x"), T.page_file_name(F.col("doc_id")).alias("name")).select("doc_id", "x.*", "name")


@query("""SELECT o_custkey AS document_id, lower(regexp_replace('## ' || o_orderpriority || ' **', '^[#*\\s]+|[#*\\s]+$', '', 'g')) AS heading, count(DISTINCT o_orderkey) AS pages
FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) >= 3""")
def headings_on_several_pages(spark, sf_dir):
    """A page per order under its priority as a heading, in customers' documents."""
    o = _read(spark, sf_dir, "orders")
    text = F.concat(F.lit("## "), "o_orderpriority", F.lit(" **\n\nOrder "), F.col("o_orderkey").cast("string"), F.lit(" was placed."))
    return chunking.repeated_headings(cleaning.page_blocks(o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page"), text.alias("text"))))


TABLE_PAGES = """items AS (SELECT l_orderkey, list(l_partkey || CASE WHEN l_linenumber % 4 = 3 THEN ' of ' ELSE ' | ' END || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows FROM lineitem GROUP BY 1),
typed AS (SELECT l_orderkey, array_to_string(rows, chr(10)) AS block,
  CASE WHEN len(rows) >= 2 AND len(list_filter(rows, lambda x: contains(x, '|'))) >= 0.8 * len(rows) THEN 'table' WHEN len(rows) = 1 THEN 'heading' ELSE 'text' END AS kind FROM items)"""


@query(f"WITH {TABLE_PAGES} SELECT kind, count(*) AS n, sum(greatest(1, length(block) // 4)) AS tokens FROM typed GROUP BY 1")
def table_blocks(spark, sf_dir):
    """A page of rows per order: tables where four in five lines hold a cell border, single lines as headings."""
    border = F.when(F.col("l_linenumber") % 4 == 3, " of ").otherwise(" | ")
    row = F.concat(F.col("l_partkey").cast("string"), border, F.col("l_suppkey").cast("string"))
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row"))))["row"].alias("rows"))
    blocks = chunking.typed_blocks(items.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.array_join("rows", "\n").alias("text")))
    return blocks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


STEPS = """items AS (SELECT l_orderkey % 100 AS d, l_orderkey AS page, list((l_linenumber || '. fit part ' || l_partkey) ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1, 2),
parts AS (SELECT d, page, array_to_string(x, chr(10)) AS block, len(x) AS steps FROM items),
both_kinds AS (SELECT d, page, 1 AS pos, block, 'procedure' AS kind FROM parts UNION ALL SELECT d, page, 2, 'Order ' || page || ' is complete.', 'text' FROM parts WHERE page % 2 = 0),
islands AS (SELECT *, sum(CASE WHEN kind = 'procedure' AND prev = 'procedure' THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY d ORDER BY page, pos) AS prev FROM both_kinds)),
merged AS (SELECT d, island, any_value(kind) AS kind, string_agg(block, chr(10) ORDER BY page, pos) AS block, min(page) AS page, max(page) AS page_end, bool_and(page % 3 > 0) AS plain, bool_or(page % 7 = 0) AS structural FROM islands GROUP BY 1, 2)"""


@query(f"""WITH {STEPS} SELECT d AS document_id, page AS page_start, page_end, block AS content, CASE WHEN plain THEN 'text' ELSE 'vision' END AS extraction_path, structural, greatest(1, length(block) // 4) AS token_count
FROM merged""")
def oversized_procedures(spark, sf_dir):
    """Steps across pages with a limit of one token: each block is a chunk, with its pages, path and structural flag."""
    pages = _steps(spark, sf_dir).withColumn("extraction_path", F.when(F.col("page") % 3 == 0, "vision").otherwise("text")).withColumn("structural", F.col("page") % 7 == 0)
    blocks = chunking.with_sections(chunking.merge_atomic(chunking.typed_blocks(pages)))
    return chunking.pack(blocks, most=1, overlap=0).select("document_id", "page_start", "page_end", "content", "extraction_path", "structural", "token_count")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS seen FROM customer""")
def vision_sentinel(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    return c.select("c_custkey", T.without_sentinel(F.when(F.col("c_custkey") % 3 == 0, f" {T.NO_CONTENT}\n").otherwise(F.col("c_name"))).alias("seen"))


@query("""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END ELSE 'old' END AS manufacturer, c_custkey % 3 = 0 AS metadata_confirmed,
  CASE WHEN c_custkey % 4 = 1 THEN 'done' ELSE 'review' END AS status FROM customer""")
def review_forms(spark, sf_dir):
    """Confirmed metadata, blank fields as null, and approvals."""
    k = F.col("document_id")
    documents = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_mktsegment", F.lit("old").alias("manufacturer"), F.lit(False).alias("metadata_confirmed"), F.lit("review").alias("status"))
    forms = documents.where(k % 3 == 0).select("document_id", F.when(k % 2 == 0, " \t ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("manufacturer"))
    confirmed = views.confirm_metadata(documents, forms)
    return views.approve(confirmed, documents.where(k % 4 == 1)).drop("c_mktsegment")


@query("SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'new' || c_custkey ELSE c_mktsegment END AS manufacturer, c_name AS revision FROM customer")
def patched_documents(spark, sf_dir):
    """Column patches by key; a null is written too."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("manufacturer"), F.col("c_name").alias("revision"))
    k = F.col("document_id")
    return store.patch(c, c.where(k % 3 < 2).select("document_id", F.when(k % 3 == 1, F.concat(F.lit("new"), k.cast("string"))).alias("manufacturer")), "document_id")


@query("SELECT c_custkey AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'queued' END AS status, c_custkey % 2 = 0 AS metadata_confirmed, true AS has_times FROM customer")
def inserted_documents(spark, sf_dir):
    """New rows get the defaults of the table, given values stay."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    shape = c.select("document_id", F.lit("done").alias("status"), F.lit(True).alias("metadata_confirmed"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    table, _ = store.insert_documents(shape.where("document_id % 2 = 0"), c.where("document_id % 2 = 1"))
    return table.select("document_id", "status", "metadata_confirmed", (F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()).alias("has_times"))


@query("""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN 'queued' ELSE 'review' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN 'late' END AS error_message, count(o_orderkey) FILTER (c_custkey % 3 <> 0) AS vectors, count(o_orderkey) AS chunks
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def reprocess_embeddings(spark, sf_dir):
    """Documents set back to embedding: queued without an error, their vectors cleared, their chunks kept."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    documents = c.select(F.col("c_custkey").alias("document_id"), F.lit("review").alias("status"), F.lit("late").alias("error_message"))
    chunks = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"))
    out = store.reprocess({"documents": documents, "chunks": chunks}, documents.where("document_id % 3 = 0"), "embed")
    counts = out["chunks"].groupBy("document_id").agg(F.count("embedding").alias("vectors"), F.count(F.lit(1)).alias("chunks"))
    return out["documents"].join(counts, "document_id", "left").fillna(0, ["vectors", "chunks"])


@query("""SELECT c_custkey AS document_id, count(o_orderkey) AS chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 GROUP BY 1""")
def hard_reset(spark, sf_dir):
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    tables = {"documents": c.withColumnRenamed("c_custkey", "document_id"), "chunks": o.withColumnRenamed("o_custkey", "document_id")}
    left = store.hard_reset(tables, tables["documents"].where("document_id % 5 = 0"))
    counts = left["chunks"].groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return left["documents"].select("document_id").join(counts, "document_id", "left").fillna(0, ["chunks"])


def _stored_orders(spark, sf_dir):
    """Customers as documents and their orders as chunks, in a store of tables cut by document."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    documents = c.select(F.col("c_custkey").alias("document_id"), F.lit("review").alias("status"), F.lit("late").alias("error_message"))
    chunks = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"))
    kept = DocumentStore(spark, _stream_folder(spark), buckets=16)
    kept.create({"documents": documents, "chunks": chunks})
    return kept


@query("""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN 'queued' ELSE 'review' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN 'late' END AS error_message,
  count(o_orderkey) FILTER (c_custkey % 3 <> 0) AS vectors, count(o_orderkey) AS chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 GROUP BY 1""")
def stored_changes(spark, sf_dir):
    """Documents set back and documents removed in stored tables, each as one operation on both tables; a repeated operation changes nothing."""
    kept = _stored_orders(spark, sf_dir)
    some, gone = (kept.table("documents").where(f"document_id % {n} = 0").select("document_id") for n in (3, 5))
    gone = materialize(gone, "removed")
    kept.change("set-back", some, lambda tables: store.reprocess(tables, some, "embed"))
    for _ in range(2):
        kept.change("removed", gone, lambda tables: store.hard_reset(tables, gone))
    counts = kept.table("chunks").groupBy("document_id").agg(F.count("embedding").alias("vectors"), F.count(F.lit(1)).alias("chunks"))
    return kept.table("documents").join(counts, "document_id", "left").fillna(0, ["vectors", "chunks"])


@query("SELECT rpad(o_orderkey::VARCHAR, 12, ' ') || '  ' || rpad(CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'done' END, 10, ' ') || '  ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '?' END AS line FROM orders")
def status_report(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    documents = o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("file_name"), F.col("o_orderdate").alias("created_at"))
    return views.status_lines(documents)


@query("SELECT o_orderkey AS document_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def documents_by_arrival(spark, sf_dir):
    """Orders as documents, the oldest first; the place each has in that order."""
    documents = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    # the sort above is by ranges: rows are numbered by their partition and their place in it
    return positions(views.documents_in_order(documents, newest_first=False)).select("document_id", F.col("position").alias("place"))


@query("""SELECT o_orderkey AS document_id, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS position,
  CAST(round(((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 137.508::DOUBLE) % 360, 0) AS INT) AS hue FROM orders""")
def document_colours(spark, sf_dir):
    return views.document_colours(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at")))


@query(f"""WITH {COMPONENTS}, degree AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1),
numbered AS (SELECT component, CAST(row_number() OVER (ORDER BY min(node)) - 1 AS BIGINT) AS cluster, count(*) AS cluster_size FROM components GROUP BY 1)
SELECT node, label AS document_id, CASE WHEN label % 2 = 0 THEN 'file ' || label ELSE '?' END AS document_name, coalesce(degree, 0) AS degree, cluster, cluster_size
FROM components JOIN embeddings ON vec_id = node JOIN numbered USING (component) LEFT JOIN degree USING (node)""")
def graph_nodes(spark, sf_dir):
    """Nodes of the similarity graph with names, degrees and clusters numbered in order of their first member."""
    chunks = chunks_of(spark, sf_dir)
    nodes = chunks.select(F.col("chunk_id").alias("node"), F.col("document").alias("document_id"))
    documents = nodes.where("document_id % 2 = 0").select("document_id", F.concat(F.lit("file "), F.col("document_id").cast("string")).alias("file_name")).distinct()
    colours = documents.select("document_id", F.lit(0).alias("hue"))
    edges = _edges(spark, sf_dir)
    return graph.graph_nodes(nodes, edges, _components(spark, sf_dir, edges), documents, colours).drop("hue")


@query(f"""WITH {COMPONENTS} SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM embeddings WHERE vec_id % 3 > 0) AS embedded_chunks,
  (SELECT count(*) FROM (SELECT component FROM components GROUP BY 1 HAVING count(*) >= 2)) AS clusters""")
def headline_counts(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).alias("embedding"))
    return flags.headline_counts(_read(spark, sf_dir, "customer"), chunks, _components(spark, sf_dir))


@query("""SELECT doc_id % 100 AS document_id, count(*) AS n_chunks, array_to_string(list(doc_id || ':' || greatest(1, length(text) // 4) || ':' || CASE WHEN doc_id % 9 = 0 THEN 'runt' ELSE '' END ORDER BY doc_id), ',') AS stats FROM documents GROUP BY 1""")
def chunk_lists(spark, sf_dir):
    lists = flags.chunk_lists(_flag_tables(spark, sf_dir)[1])
    each = lambda x: F.concat_ws(":", x["chunk_id"].cast("string"), x["token_count"].cast("string"), F.coalesce(x["section_type"], F.lit("")))
    return lists.select("document_id", "n_chunks", F.array_join(F.transform("stats", each), ",").alias("stats"))


@query(f"""WITH {FLAGS.replace("THEN 'cleaning-safety-rail'", "THEN 'Cleaning stopped: stopped'").replace("THEN 'no-chunks'", "THEN 'No chunks from ' || pages || ' pages'").replace("THEN 'low-content-density'", "THEN 'Little text: ' || CAST(round(tokens / pages, 0) AS INT) || ' tokens a page'").replace("THEN 'short-chunks'", "THEN short_chunks || ' very short chunks'").replace("THEN 'heavily-vision'", "THEN vision_chunks || ' of ' || n_chunks || ' chunks were read from images'").replace("THEN 'manufacturer-prose'", "THEN 'Manufacturer reads like a sentence'").replace("THEN 'revision-prose'", "THEN 'Revision reads like a sentence'").replace("THEN 'no-doc-type'", "THEN 'Document type is not known'")}
SELECT document_id, array_to_string(f, '; ') AS labels FROM flags""")
def flag_labels(spark, sf_dir):
    found = flags.document_flags(*_flag_tables(spark, sf_dir))
    return found.select("document_id", F.array_join("flags.label", "; ").alias("labels"))


@query("""WITH lines AS (SELECT DISTINCT n_regionkey, regexp_replace(n_name, '\\d+', '#', 'g') AS l FROM nation)
SELECT n_regionkey AS document_id, '["' || array_to_string(list(l ORDER BY l), '","') || '"]' AS json FROM lines GROUP BY 1""")
def override_files(spark, sf_dir):
    """Lines that people restored, as sorted JSON lists: old and new ones together, each once."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("document_id"), T.normalize_line(F.col("n_name")).alias("normalized"), "n_nationkey")
    old = n.where("n_nationkey % 2 = 0").groupBy("document_id").agg(F.to_json(F.collect_list("normalized")).alias("json"))
    return files.write_overrides(old, n)


@query(f"{REPORT} SELECT document_id, total_pages, total_lines, stripped_lines, stripped_pct, stripped_pct > 15 AS safety_rail_triggered, (SELECT count(*) FROM furniture f WHERE f.document_id = r.document_id) AS furniture FROM report r")
def report_files(spark, sf_dir):
    """Reports written as JSON with their furniture lines, and read back."""
    done = _cleaned(spark, sf_dir)
    json = views.report_json(done.report, cleaning.furniture_examples(done.candidates, done.furniture))
    lines = json.select("document_id", F.coalesce(F.json_array_length(F.get_json_object("json", "$.furniture")), F.lit(0)).cast("long").alias("furniture"))
    return views.read_report(json).join(lines, "document_id")


@query("SELECT vec_id AS chunk_id, CAST(vec_id % 5 AS INT) AS found_width FROM embeddings WHERE vec_id % 5 <> 3")
def vector_widths(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.slice("embedding", F.lit(1), (F.col("vec_id") % 5).cast("int")).alias("embedding"))
    return views.check_vectors(v, 3)


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 9 = 0")
def set_aside_chunks(spark, sf_dir):
    return views.set_aside(_flag_tables(spark, sf_dir)[1]).select("chunk_id")


@query("""SELECT vec_id AS chunk_id, label AS document_id, CASE WHEN label % 3 = 0 THEN '?' ELSE 'file ' || label END AS document_name FROM embeddings WHERE vec_id % 4 > 0""")
def named_chunks(spark, sf_dir):
    """Embedded chunks of the graph page with the names of their documents."""
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), F.when(F.col("vec_id") % 4 > 0, F.col("embedding")).alias("embedding"))
    names = v.where("document_id % 3 > 0").select("document_id", F.concat(F.lit("file "), F.col("document_id").cast("string")).alias("file_name")).distinct()
    return views.with_document_names(views.graph_chunks(v), names)


@query("SELECT doc_id AS chunk_id, source AS document_id FROM documents WHERE source = (SELECT min(source) FROM documents) AND doc_id % 3 = 0")
def missing_vectors(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    low = docs.agg(F.min("source")).first()[0]
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit(1.0))).alias("embedding"))
    return vectors.missing_vectors(chunks, low).drop("embedding")


@query("SELECT doc_id AS chunk_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS chunk_index FROM documents WHERE source = (SELECT max(source) FROM documents)")
def chunks_in_order(spark, sf_dir):
    """One document's chunks in order."""
    docs = _read(spark, sf_dir, "documents")
    last = docs.agg(F.max("source")).first()[0]
    index = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), index.alias("chunk_index"))
    return views.document_chunks(chunks, last).select("chunk_id", "chunk_index")

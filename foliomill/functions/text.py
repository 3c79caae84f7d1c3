"""Text rules as Column expressions: everything stays inside the JVM's generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the documents' existing rules for like results.
SAFETY = r"(?i)\b(warning|caution|danger|note:)\b"
STRUCTURAL_HEADING = r"(?i)^(contents|index|revision|document history)"
TOC_LINE = r"(?U)(\.{2,}|\s{2,})\s*\d{1,4}\s*$"
STEP_LINE = r"(?U)^\s*\d+[.)]\s+\S"
FIELD_LINE = r"^\*\*[^*\n]+:\*\*"
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"
MAX_FURNITURE_CHARS = 80
MAX_HEADING_CHARS = 80
NO_CONTENT = "NO_CONTENT"
DOC_TYPES = ("engineering_manual", "install_manual", "datasheet", "user_manual", "other")


#: all white space, as the Unicode standard lists it, and the four separators U+001C to U+001F
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def paragraphs(c: Column) -> Column:
    """Stripped, non-empty parts between blank lines; none for null."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)\n\s*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def text_lines(c: Column) -> Column:
    return F.filter(F.split(c, LINE_BREAK), lambda x: strip(x) != "")


def normalize_line(c: Column) -> Column:
    """Lines that differ in spacing and numbers only become equal."""
    return F.regexp_replace(collapse(c), r"(?U)\d+", "#")


def is_protected(c: Column) -> Column:
    """Long lines and safety notices are never page furniture."""
    return (F.length(c) > MAX_FURNITURE_CHARS) | c.rlike(SAFETY)


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def normalize_heading(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"(?U)^[#*\s]+|[#*\s]+$", "")))


def is_toc_line(c: Column) -> Column:
    return c.rlike(TOC_LINE)


def _share(c: Column, test: Callable[[Column], Column], least: float, lines: int) -> Column:
    every = text_lines(c)
    hits = F.size(F.filter(every, test))
    return (F.size(every) >= lines) & (hits >= F.lit(least) * F.size(every))


def is_table(c: Column) -> Column:
    return c.contains("|") & _share(c, lambda x: x.contains("|"), 0.8, 2)


def is_procedure(c: Column) -> Column:
    return c.rlike(r"(?U)\d[.)]") & _share(c, lambda x: x.rlike(STEP_LINE), 0.6, 1)


def is_heading_shaped(c: Column) -> Column:
    return (F.length(c) <= MAX_HEADING_CHARS) & (F.size(text_lines(c)) == 1) & ~c.rlike(r"[.,;:]$") & ~c.rlike(FIELD_LINE)


def block_kind(c: Column, is_heading: Column) -> Column:
    """The first that fits of table, procedure, heading (as the caller knows), text."""
    return F.when(is_table(c), "table").when(is_procedure(c), "procedure").when(is_heading, "heading").otherwise("text")


def is_table_dense(c: Column) -> Column:
    """At least 12 lines, 65 % of them of at most 20 characters."""
    every = text_lines(F.coalesce(c, F.lit("")))
    short = F.size(F.filter(every, lambda x: F.length(strip(x)) <= 20))
    return (F.size(every) >= 12) & (short >= 0.65 * F.size(every))


def needs_vision(c: Column, blank_or_flat: Column) -> Column:
    return F.when(F.length(strip(F.coalesce(c, F.lit("")))) < 50, ~blank_or_flat).otherwise(is_table_dense(c))


def without_sentinel(c: Column) -> Column:
    return F.when(strip(c) == NO_CONTENT, "").otherwise(c)


def cut_repetition(c: Column, most_period: int = 3, least_copies: int = 3) -> Column:
    """A text up to one copy of the first paragraph cycle that repeats at least so many times; else unchanged."""

    def first_start(same: Column, p: int) -> Column:
        # a cycle of period p starts where p * (least_copies - 1) paragraphs in a row equal the one p further on
        def step(acc: Column, i: Column) -> Column:
            run = F.when(F.element_at(same, i) == F.element_at(same, i + p), acc["run"] + 1).otherwise(F.lit(0))
            start = F.coalesce(acc["start"], F.when(run >= p * (least_copies - 1), i - run + 1))
            return F.struct(run.alias("run"), start.alias("start"))

        places = F.when(F.size(same) > p, F.sequence(F.lit(1), F.size(same) - p)).otherwise(F.array().cast("array<int>"))
        begin = F.struct(F.lit(0).alias("run"), F.lit(None).cast("int").alias("start"))
        return F.aggregate(places, begin, step, lambda acc: F.when(acc["start"].isNotNull(), F.struct(acc["start"].alias("start"), F.lit(p).alias("period"))))

    def first_cycle(same: Column) -> Column:
        return F.array_min(F.array(*[first_start(same, p) for p in range(1, most_period + 1)]))

    # one-element arrays bind what is used repeatedly, so that it is computed once and not once per paragraph
    bound = F.transform(F.array(paragraphs(c)), lambda p: F.struct(p.alias("plain"), F.transform(p, collapse).alias("same")))
    bound = F.transform(bound, lambda b: F.struct(b["plain"].alias("plain"), first_cycle(b["same"]).alias("hit")))
    cut = F.transform(bound, lambda b: F.when(b["hit"].isNotNull(), F.array_join(F.slice(b["plain"], F.lit(1), b["hit"]["start"] + b["hit"]["period"] - 1), "\n\n")))
    return F.coalesce(F.get(cut, F.lit(0)), c)


def parse_metadata(raw: Column) -> Column:
    """Struct of the four fields in the first {...} of a model's reply; null where there is no object."""
    body = F.regexp_extract(F.regexp_replace(raw, r"(?m)^```\w*\s*$", ""), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(body != "", body), "manufacturer string, panel_model string, doc_type string, revision string")
    field = lambda name: F.nullif(parsed[name], F.lit("")).alias(name)
    kind = F.when(parsed["doc_type"].isin(*DOC_TYPES), parsed["doc_type"]).otherwise("other").alias("doc_type")
    return F.when(body != "", F.struct(field("manufacturer"), field("panel_model"), kind, field("revision")))


def form_text(c: Column) -> Column:
    """Stripped of all white space at the ends; blank as null."""
    return F.nullif(strip(c), F.lit(""))


def looks_like_prose(c: Column) -> Column:
    return F.coalesce((F.length(c) > 40) | c.contains("("), F.lit(False))


def chunk_label(section: Column, index: Column, page: Column) -> Column:
    where = F.concat(F.lit(" (p."), F.coalesce(page.cast("string"), F.lit("?")), F.lit(")"))
    return F.concat(F.coalesce(F.nullif(section, F.lit("")), F.concat(F.lit("Chunk #"), F.coalesce(index.cast("string"), F.lit("?")))), where)


def page_range(first: Column, last: Column) -> Column:
    return F.concat(F.lit("p."), first.cast("string"), F.when(first != last, F.concat(F.lit("–"), last.cast("string"))).otherwise(""))


def hue(index: Column) -> Column:
    """Golden-angle hue of a position."""
    return F.round(F.pmod(index * F.lit(137.508), F.lit(360.0)), 0).cast("int")


def stage_index(status: Column) -> Column:
    """Position of a status in the life cycle; unknown ones start at 0, failed is -1."""
    stages = {"queued": 0, "extracting": 1, "chunking": 2, "embedding": 3, "review": 4, "done": 4, "failed": -1}
    mapping = F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, status), F.lit(0))


def page_file_name(page: Column) -> Column:
    text = page.cast("string")
    return F.concat(F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text), F.lit(".md"))


def read_page_file(c: Column) -> Column:
    """(extraction_path, structural, text) of a page file with or without its markers."""
    marker = r"^<!-- path: (text|vision) -->\n(?:<!-- structural: (true|false) -->\n)?"
    path = F.nullif(F.regexp_extract(c, marker, 1), F.lit(""))
    return F.struct(F.coalesce(path, F.lit("text")).alias("extraction_path"), (F.regexp_extract(c, marker, 2) == "true").alias("structural"), F.regexp_replace(c, marker, "").alias("text"))


def write_page_file(path: Column, text: Column, structural: Column | None = None) -> Column:
    first = F.concat(F.lit("<!-- path: "), path, F.lit(" -->\n"))
    if structural is None:
        return F.concat(first, text)
    return F.concat(first, F.lit("<!-- structural: "), structural.cast("string"), F.lit(" -->\n"), text)

"""Packing ordered blocks into overlapping chunks by next-start pointers.

Where a chunk's first new block ("opener") is j, all else about it follows from the running
sums of tokens: it reaches back to the last block that leaves ``overlap`` tokens before j,
but not beyond the last block that stands alone, and it ends before the first block that
makes it exceed the limit, which opens the next chunk. So every block gets a pointer to
the opener that would follow if it were one itself, by windows over running sums, and the
chunks are what the pointers reach from the first block.

Blocks that stand alone cut a document into segments that are packed apart. Long segments
are cut into stretches of bounded length. Within a stretch pointers are doubled until they
leave it; what different blocks of a stretch leave to are few places, so the pointers from
such place to such place are a small table. In it, the places on the way from a segment's
first block are found by doubling too, in a number of joins logarithmic in the number of
stretches. These are the stretches' entries, and each stretch is then walked from its own. No
document or segment is ever in one row or group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.plans.workspace import materialize

#: rows in a task's group of stretches, about
GROUP_ROWS = 1 << 16


def pointers(blocks: DataFrame, most: int, overlap: int) -> DataFrame:
    """``blocks`` (document_id, i from 1, tokens, atomic) as document_id, seg, at (from 1 in the segment), size (of the segment), i, first, next.

    ``first`` is the block that a chunk opened at ``i`` begins with, ``next`` the place in the
    segment of the opener after it (beyond ``size`` for none).
    """
    alone = F.col("atomic") & (F.col("tokens") > most)
    in_document = Window.partitionBy("document_id").orderBy("i")
    cut = alone | F.coalesce(F.lag(alone).over(in_document), F.lit(False))
    cut_rows = blocks.withColumn("cut", cut).withColumn("seg", F.sum(F.col("cut").cast("int")).over(in_document.rowsBetween(Window.unboundedPreceding, 0)))
    in_segment = Window.partitionBy("document_id", "seg").orderBy("i")
    before = F.coalesce(F.sum("tokens").over(in_segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = cut_rows.withColumn("before", before).withColumn("at", F.row_number().over(in_segment))
    # tokens are positive, so the order of the running sums is the order of the blocks
    by_sum = Window.partitionBy("document_id", "seg").orderBy("before")
    reached = F.last(F.struct("at", (F.col("before") + F.col("tokens")).alias("behind"))).over(by_sum.rangeBetween(Window.unboundedPreceding, most))
    placed = placed.withColumn("reached", reached)
    over = F.when(F.col("reached")["behind"] > F.col("before") + most, F.col("reached")["at"]).otherwise(F.col("reached")["at"] + 1)
    start = F.struct(F.col("i").alias("first"), over.alias("over"))
    placed = placed.withColumn("start", start)
    # of a block that opens a chunk: the chunk's first block and the first one that is too much for it
    if overlap > 0:
        tail = F.last("start").over(by_sum.rangeBetween(Window.unboundedPreceding, -overlap))
        lowest = F.first("start").over(by_sum.rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("start", F.coalesce(tail, lowest))
    size = F.count(F.lit(1)).over(Window.partitionBy("document_id", "seg"))
    return placed.select("document_id", "seg", "at", size.cast("int").alias("size"), "i", F.col("start")["first"].alias("first"), F.greatest(F.col("at") + 1, F.col("start")["over"]).cast("int").alias("next"))


def _sorted_groups(table: pa.Table, stretch: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(table by segment and place, number of the stretch's group in it, places, row of each next pointer or -1 where it leaves the stretch)."""
    table = table.sort_by([("document_id", "ascending"), ("seg", "ascending"), ("at", "ascending")])
    at, following = table["at"].to_numpy(), table["next"].to_numpy().astype(np.int64)
    # a stretch's rows stand together and their places count up by one
    fresh = np.ones(len(at), bool)
    documents = table["document_id"].combine_chunks()
    same = np.zeros(0, bool) if len(at) < 2 else np.array(pc.equal(documents[1:], documents[:-1]).fill_null(False)) & (np.diff(table["seg"].to_numpy()) == 0)
    both_null = np.zeros(0, bool) if len(at) < 2 else np.array(documents.is_null())[1:] & np.array(documents.is_null())[:-1] & (np.diff(table["seg"].to_numpy()) == 0)
    fresh[1:] = ~((same | both_null) & (np.diff(at) == 1) & ((at[1:] - 1) // stretch == (at[:-1] - 1) // stretch))
    number = np.cumsum(fresh) - 1
    rows = np.arange(len(at)) + following - at
    end = np.append(np.flatnonzero(fresh)[1:], len(at))[number] if len(at) else rows
    return table, number, at, np.where(rows < end, rows, -1)


def _leave(table: pa.Table, stretch: int) -> pa.Table:
    """Where each block's pointers leave its stretch, unless they leave the segment."""
    table, _, _, row = _sorted_groups(table, stretch)
    last = np.where(row < 0, np.arange(len(row)), row)
    while len(last) and (jumped := last[last] != last).any():
        last = last[last]
    out = table.select(["document_id", "seg", "at"]).append_column("exit", table["next"].take(pa.array(last)))
    return out.filter(pc.less_equal(out["exit"], table["size"]))


def _walk(table: pa.Table, stretch: int) -> pa.Table:
    """The blocks on the way from the stretches' entries; a stretch's rows all carry its entry (null: no chunk is opened in it)."""
    table, number, at, row = _sorted_groups(table, stretch)
    entry = table["entry"].combine_chunks().fill_null(0).to_numpy()
    here = np.flatnonzero(entry == at)
    found = []
    while len(here):
        found.append(here)
        here = row[here]
        here = here[here >= 0]
    return table.take(pa.array(np.concatenate([np.zeros(0, np.int64), *found]))).select(["document_id", "seg", "at", "size", "i", "first", "next"])


def openers(nodes: DataFrame, stretch: int = 4096) -> DataFrame:
    """The rows of ``pointers`` that open a chunk."""
    document = nodes.schema["document_id"].dataType.simpleString()
    nodes = materialize(nodes, "pack-pointers")
    groups = max(1, math.ceil(nodes.count() / GROUP_ROWS))
    by_stretch = F.floor((F.col("at") - 1) / stretch).cast("int")
    nodes = nodes.withColumn("stretch", by_stretch)
    group = F.pmod(F.xxhash64("document_id", "seg", "stretch"), F.lit(groups)).alias("g")
    long = nodes.where(F.col("size") > stretch)
    places = ["document_id", "seg", "at"]
    entries = None
    if not long.isEmpty():
        left = long.groupBy(group).applyInArrow(lambda t: _leave(t, stretch), f"document_id {document}, seg long, at int, exit int")
        left = materialize(left, "pack-exits")
        places_left = left.select("document_id", "seg", F.col("exit").alias("at")).unionByName(left.select("document_id", "seg", F.lit(1).alias("at"))).distinct()
        hop = materialize(left.join(places_left, places), "pack-hops")
        way = left.select("document_id", "seg", F.lit(1).alias("at")).distinct()
        hops = []
        while not hop.isEmpty():
            hops.append(hop)
            ahead = hop.select("document_id", "seg", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
            hop = materialize(hop.join(ahead, ["document_id", "seg", "exit"]).select(*places, F.col("beyond").alias("exit")), "pack-hops")
        for hop in reversed(hops):
            way = materialize(way.unionByName(way.join(hop, places).select("document_id", "seg", F.col("exit").alias("at"))), "pack-way")
        entries = way.select("document_id", "seg", by_stretch.alias("stretch"), F.col("at").alias("entry"))
        nodes = nodes.join(entries, ["document_id", "seg", "stretch"], "left")
    entry = F.when(F.col("stretch") == 0, F.lit(1))
    nodes = nodes.withColumn("entry", entry if entries is None else F.coalesce(entry, F.col("entry")))
    shape = f"document_id {document}, seg long, at int, size int, i int, first int, next int"
    return nodes.groupBy(group).applyInArrow(lambda t: _walk(t, stretch), shape)


def spans(blocks: DataFrame, most: int, overlap: int, stretch: int = 4096) -> DataFrame:
    """(document_id, chunk_index, first, last, opener) of the chunks of ``blocks`` (document_id, i from 1, tokens, atomic); i numbers a document's blocks."""
    found = openers(pointers(blocks, most, overlap), stretch)
    last = F.col("i") + F.least("next", F.col("size") + 1) - F.col("at") - 1
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("i")) - 1
    return found.select("document_id", index.alias("chunk_index"), "first", last.cast("int").alias("last"), F.col("i").alias("opener"))

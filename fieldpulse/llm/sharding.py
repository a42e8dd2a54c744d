"""Even shards by histogram sort, in DataFrame functions only.

Every row has a 60-bit key: 36 bits of the text's MD5 and 24 bits of the row id's MD5. Equal
texts lie side by side, and a hot text still spreads over many keys. Shard j begins at the
first key with at least j/n of all bytes before it. The splitters are found by counting:
each round cuts the cells that still hold a wanted splitter into 1024 smaller ones, sums
their exact bytes in one aggregation over the sizes, and keeps at most one cell for each
splitter, until the bytes before every splitter are within the tolerance or the cell holds
one key only. Then the small rows (no text) are exchanged once, by cells that are finer than
shards, to number the rows of each shard without gaps. The cells come from counting too: a cell
of too many rows is cut by the next bits of the key until its pieces are small, so a text that a
third of all rows share is numbered by many tasks, along the bits of the row ids.

Law `bytes`: shard sizes differ from the mean by at most one key's bytes and the tolerance.
Defined cases: a NULL text has no bytes and checksum 0; a NULL id hashes like an empty one;
rows that agree in text and id stay in one shard; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

KEY_BITS = 60
ROUND_BITS = 10  # each round looks at 2**10 cells for each splitter
ROW_OVERHEAD = 8  # bytes added to every text
SHARDS = 24
ROWS_PER_CELL = 500_000  # rows that one task numbers: on average, and at most twice as many but for equal keys


def _md5_bits(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def with_key(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, _key) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    of_id = F.coalesce(F.col(row_id).cast("string"), F.lit(""))
    return docs.select(
        F.col(row_id).alias("doc_id"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        (_md5_bits(body, 9) * F.lit(1 << 24) + _md5_bits(of_id, 6)).alias("_key"),
    )


def find_splitters(sized: DataFrame, n_shards: int, tolerance: int = 0) -> list[int]:
    """n_shards - 1 keys; a row belongs to the shard numbered by the splitters at or below its key.

    The driver holds at most n_shards - 1 open cells of 1024 sums each.
    """
    total = sized.agg(F.sum("size")).first()[0] or 0
    wanted = {j: -(-j * total // n_shards) for j in range(1, n_shards)}
    found: dict[int, int] = {}
    shift = KEY_BITS
    # open cell of a splitter: (cell number at `shift` bits, exact bytes below the cell)
    open_cells = {j: (0, 0) for j in wanted}
    while open_cells:
        finer = max(shift - ROUND_BITS, 0)
        parents = sorted({cell for cell, _ in open_cells.values()})
        inside = sized if shift == KEY_BITS else sized.filter(F.shiftright("_key", shift).isin(parents))
        cells = (
            inside.groupBy(F.shiftright("_key", finer).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.min("_key").alias("low"), F.max("_key").alias("high"))
            .collect()
        )
        by_parent: dict[int, list] = {}
        for c in sorted(cells, key=lambda c: c["cell"]):
            by_parent.setdefault(c["cell"] >> (shift - finer), []).append(c)
        still = {}
        for j, (parent, below) in open_cells.items():
            for c in by_parent.get(parent, []):
                after = below + c["bytes"]
                if after >= wanted[j]:
                    if after - wanted[j] <= tolerance or c["low"] == c["high"]:
                        found[j] = c["high"] + 1
                    else:
                        still[j] = (c["cell"], below)
                    break
                below = after
            else:  # no bytes at all
                found[j] = 0
        open_cells, shift = still, finer
    return [found[j] for j in sorted(found)]


def find_cells(sized: DataFrame, n_rows: int, rows_per_cell: int) -> list[tuple[int, list[int]]]:
    """[(shift, cells of at most that width that are cut further)], widest first; the last list is empty.

    Each round counts the rows inside the cells that are too full, by the next bits of the key.
    The driver holds only full cells, of which there are at most n_rows / (2 * rows_per_cell).
    """
    shift = KEY_BITS - max(0, (n_rows // rows_per_cell).bit_length())
    levels: list[tuple[int, list[int]]] = []
    while True:
        inside = sized if not levels else sized.filter(F.shiftright("_key", levels[-1][0]).isin(levels[-1][1]))
        cells = inside.groupBy(F.shiftright("_key", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        full = [r["cell"] for r in cells.filter(F.col("n") > 2 * rows_per_cell).collect()] if shift else []
        levels.append((shift, full))
        if not full:
            return levels
        shift = max(shift - ROUND_BITS, 0)


def cell_of(levels: list[tuple[int, list[int]]]) -> Column:
    """The lowest key of a row's cell. A cell that was cut is no cell, so the lowest keys differ."""
    cell = None
    for shift, full in reversed(levels):
        own = F.shiftleft(F.shiftright("_key", shift), shift)
        cell = own if cell is None else F.when(F.shiftright("_key", shift).isin(full), cell).otherwise(own)
    return cell


def shard(docs: DataFrame, n_shards: int = SHARDS, row_id: str = "doc_id", text: str = "text",
          tolerance: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (NULL: the law is not `key`) of every row."""
    sized = materialize(with_key(docs, row_id, text), "sized")
    splitters = find_splitters(sized, n_shards, tolerance)
    at_or_below = sum((F.when(F.col("_key") >= s, 1).otherwise(0) for s in splitters), F.lit(0))
    n_rows = sized.count()
    cells = find_cells(sized, n_rows, ROWS_PER_CELL)
    placed = sized.withColumn("shard", at_or_below.cast("int")).withColumn("_cell", cell_of(cells))
    # rows before each piece of a shard: one small row for each shard and cell
    pieces = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    in_piece = Window.partitionBy("shard", "_cell").orderBy("_key", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("_rank", F.row_number().over(in_piece))
        .join(offsets, ["shard", "_cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_before") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


SQL = """
WITH d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, size, ('0x' || substr(md5(t), 1, 9))::BIGINT * 16777216
        + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT AS key FROM d),
b AS (SELECT key, coalesce(sum(sum(size)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
        AS before, sum(sum(size)) OVER ()::BIGINT AS total FROM k GROUP BY key)
SELECT doc_id, size, ((24 * before) // total)::INT AS shard,
       row_number() OVER (PARTITION BY (24 * before) // total ORDER BY k.key, doc_id) - 1 AS slot,
       'bytes' AS law, NULL::INT AS grown_shard
FROM k JOIN b ON k.key = b.key
"""


@query("op7_sharding")
def op7_sharding(spark, folder):
    return shard(table(spark, folder, "documents"), SHARDS)

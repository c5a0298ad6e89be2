"""Office documents as rows of pieces in reading order; reading the bytes themselves is left to the caller's own reader.

Positions, full text, heading attachment and table headers are DataFrame work shared with every other source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pigeonhole.functions.json import let
from pigeonhole.operators.outline import assemble_full_text, table_headers

PIECES = "path string, fingerprint string, seq bigint, section bigint, kind string, text string, level int, table_id bigint, row int, cells array<string>, header_row boolean"


def outline_from_pieces(pieces: DataFrame) -> dict[str, DataFrame]:
    """``documents`` (full_text, title, code), ``headings``, ``blocks`` and ``tables`` of files given as ``PIECES`` rows.

    Kinds: ``marker`` (a page or slide begins), ``heading`` with its level, ``text``, ``anchor`` (a table begins), ``row`` with
    its cells, ``title``, and ``failure`` with a text ``code: detail`` for a file that couldn't be read. Cut or store the
    pieces first when several of the four tables are used.
    """
    keys = ["path", "fingerprint"]
    failed = pieces.filter("kind = 'failure'").select(*keys, F.split("text", ": ", 2).alias("_f"))
    titles = pieces.filter("kind = 'title'").select(*keys, F.col("text").alias("title"))
    content = pieces.filter("kind not in ('failure', 'title')")
    carry = ["section", "level", "table_id", "row", "cells", "header_row"]
    assembled = assemble_full_text(content, keys, carry)
    items = assembled.select(*keys, F.inline("items"))
    within = W.partitionBy(*keys, "section").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    own = F.concat(F.lit("heading_"), F.col("position").cast("string"))
    placed = items.withColumn("_id", F.when(F.col("kind") == "heading", own)).withColumn("heading_id", F.last("_id", ignorenulls=True).over(within))
    kinds = F.transform("items", lambda i: i["kind"])
    has_text = let(kinds, lambda x: F.exists(x, lambda n: n.isin("heading", "text", "row")))
    documents = (assembled.select(*keys, "full_text", F.when(~has_text, "E_NO_TEXT").alias("code")).join(titles, keys, "left")
                 .select(*keys, "full_text", "title", "code")
                 .unionByName(failed.select(*keys, F.lit(None).cast("string").alias("full_text"), F.lit(None).cast("string").alias("title"), F.col("_f")[0].alias("code"))))
    starts = items.filter("kind = 'anchor'").select(*keys, "table_id", "position")
    cells = (pieces.filter("kind = 'row'").select(*keys, "table_id", "row", "header_row", F.posexplode("cells").alias("col", "text"))
             .join(starts, [*keys, "table_id"]))
    return {
        "documents": documents,
        "headings": placed.filter("kind = 'heading'").select(*keys, F.col("seq").cast("int").alias("seq"), F.col("_id").alias("id"), "text", "level", "position"),
        "blocks": placed.filter("kind in ('text', 'row')").select(*keys, F.col("seq").cast("int").alias("seq"), "position", "heading_id", "text"),
        "tables": table_headers(cells, keys),
    }

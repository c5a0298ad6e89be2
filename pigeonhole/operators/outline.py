"""Outlines: lines, headings, blocks, tables and the notes they give rise to.

Child tables are keyed by the document keys. Ordered work happens inside one document (its own row or its own
window), never across a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.arrays import running_offsets
from pigeonhole.functions.json import let
from pigeonhole.functions.text import blank, token_phrase, utf16_len, words, words_nfkc

LINE_PIECE = r"[^\r\n]*(?:\r\n|\r|\n|\z)"


def line_array(text: Column) -> Column:
    """``array<struct<line, position>>`` of nonempty lines, positions in UTF-16 units; computed inside the row."""
    pieces = F.regexp_extract_all(text, F.lit(LINE_PIECE), F.lit(0))
    return let(pieces, lambda p: F.filter(
        F.zip_with(p, running_offsets(F.transform(p, utf16_len)), lambda piece, start: F.struct(
            F.regexp_replace(piece, r"[\r\n]+$", "").alias("line"), start.alias("position"))),
        lambda l: F.length(l["line"]) > 0))


def split_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Nonempty lines with their start; CRLF, CR and LF all end a line. No shuffle."""
    return docs.select(*keys, F.inline(line_array(F.col(text)))).select(*keys, "line", "position")


def verify_recovered_headings(docs: DataFrame, candidates: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Each candidate with every position where it is a whole line; ``reason`` is set when it is none.

    ``candidates``: keys, candidate_index, candidate. The candidates of a document meet its text as one row; both are then
    grouped by the text of the line where they are, so a document with many of both costs their sum and not their product.
    """
    asked = candidates.groupBy(*keys).agg(F.collect_set(F.struct("candidate_index", "candidate")).alias("_c"))
    rows = docs.select(*keys, F.col(text).alias("_text")).join(asked, keys)
    empty = F.array().cast("array<struct<line:string,position:bigint>>")
    part = lambda text, position, asked: F.struct(text.alias("candidate"), position.cast("bigint").alias("position"), asked.alias("_asked"))
    lines = F.transform(F.coalesce(line_array(F.col("_text")), empty), lambda l: part(l["line"], l["position"], F.lit(None).cast("struct<candidate_index:bigint>")))
    wanted = F.transform("_c", lambda c: part(c["candidate"], F.lit(None), F.struct(c["candidate_index"].cast("bigint").alias("candidate_index"))))
    found = (rows.select(*keys, F.inline(F.concat(lines, wanted))).groupBy(*keys, "candidate")
             .agg(F.array_sort(F.collect_list("position")).alias("positions"), F.collect_set("_asked").alias("_asked")))
    index = F.col("_a.candidate_index").cast(candidates.schema["candidate_index"].dataType).alias("candidate_index")
    return (found.select(*keys, "candidate", "positions", F.explode("_asked").alias("_a")).select(*keys, index, "candidate", "positions")
            .withColumn("reason", F.when(F.size("positions") == 0, "not_an_exact_line")))


def merge_recovered_headings(headings: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """Existing headings plus one level-1 heading per newly verified position; an occupied position is left alone.

    ``headings``: keys, seq, id, text, level, position. Recovered rows continue the sequence in candidate order.
    """
    found = verified.select(*keys, "candidate_index", "candidate", F.explode("positions").alias("position"))
    first = found.groupBy(*keys, "position").agg(F.min_by("candidate", "candidate_index").alias("text"), F.min("candidate_index").alias("_i"))
    new = first.join(headings.select(*keys, "position"), [*keys, "position"], "left_anti")
    return headings.select(*keys, "seq", "id", "text", "level", "position").unionByName(new.select(
        *keys, (F.col("_i") + 1_000_000).cast("int").alias("seq"), F.concat(F.lit("recovered_"), F.col("position").cast("string")).alias("id"),
        "text", F.lit(1).alias("level"), "position"))


def recovered_notes(verified: DataFrame, keys: list[str]) -> DataFrame:
    return (verified.filter("reason is null").select(*keys).distinct().withColumn("note", F.lit("N_OUTLINE_RECOVERED")))


def attach_blocks(blocks: DataFrame, headings: DataFrame, keys: list[str]) -> DataFrame:
    """As-of attachment: the last heading at or before each block; without one the block keeps its old heading."""
    both = (headings.select(*keys, "position", F.lit(0).alias("_kind"), "seq", F.col("id").alias("_id"),
                            F.lit(None).cast("string").alias("heading_id"), F.lit(None).cast("string").alias("text"))
            .unionByName(blocks.select(*keys, "position", F.lit(1).alias("_kind"), "seq", F.lit(None).cast("string").alias("_id"), "heading_id", "text")))
    before = W.partitionBy(*keys).orderBy("position", "_kind", "seq").rowsBetween(W.unboundedPreceding, 0)
    return (both.withColumn("_found", F.last("_id", ignorenulls=True).over(before)).filter("_kind = 1")
            .select(*keys, "seq", "position", F.coalesce("_found", "heading_id").alias("heading_id"), "text"))


def policy_findings(policy: dict[str, float]) -> list[str]:
    """What is wrong with a layout policy (empty when usable)."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    tests = {"large_font_ratio": policy["large_font_ratio"] > 1, "gap_ratio": policy["gap_ratio"] > 1,
             "top_page_fraction": 0 < policy["top_page_fraction"] < 1,
             "maximum_heading_characters": whole(policy["maximum_heading_characters"]) and policy["maximum_heading_characters"] >= 1,
             "minimum_headings": whole(policy["minimum_headings"]) and policy["minimum_headings"] >= 0}
    return [name for name, ok in tests.items() if not ok]


def infer_layout_headings(lines: DataFrame, keys: list[str], policy: dict[str, float]) -> DataFrame:
    """Headings from page layout: large or bold, short, and at a page top or after a wide gap.

    ``lines``: keys, seq, text, page, y, font_size, bold, position, page_height, item_font_sizes.
    The body size is the most frequent item size (smaller on a tie), the usual gap the lower median.
    """
    if policy_findings(policy):
        raise ValueError(f"Invalid layout policy: {policy_findings(policy)}")
    size_rows = lines.select(*keys, F.explode(F.coalesce("item_font_sizes", F.array("font_size"))).alias("_size"))
    sizes = size_rows.groupBy(*keys, "_size").agg(F.count(F.lit(1)).alias("_n"))
    per_doc = sizes.groupBy(*keys).agg(F.max_by("_size", F.struct(F.col("_n"), -F.col("_size"))).alias("body"), F.collect_list("_size").alias("_sizes"))
    previous = W.partitionBy(*keys).orderBy("seq")
    rows = lines.withColumns({"_prev_page": F.lag("page").over(previous), "_prev_y": F.lag("y").over(previous)})
    rows = rows.withColumn("_gap", F.when(F.col("page") == F.col("_prev_page"), F.col("y") - F.col("_prev_y")))
    usual = rows.filter("_gap > 0").groupBy(*keys).agg(F.expr("percentile_disc(0.5) within group (order by _gap)").alias("_usual"))
    bound = F.col("body") * policy["large_font_ratio"]
    rows = rows.join(per_doc, keys).join(usual, keys, "left").withColumn(
        "_large_sizes", F.array_sort(F.filter("_sizes", lambda s: s >= bound), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)))
    large = F.col("font_size") >= bound
    after_gap = F.coalesce(F.col("_gap") > F.coalesce("_usual", "body") * policy["gap_ratio"], F.lit(False))
    keep = ((large | F.col("bold")) & (utf16_len(F.col("text")) <= policy["maximum_heading_characters"])
            & ((F.col("y") <= F.col("page_height") * policy["top_page_fraction"]) | after_gap))
    level = F.when(large, F.array_position("_large_sizes", F.col("font_size"))).otherwise(F.size("_large_sizes") + 1)
    return rows.filter(keep).select(*keys, "seq", F.concat(F.lit("heading_"), F.col("position").cast("string")).alias("id"),
                                    "text", level.cast("int").alias("level"), "position")


def needs_outline_recovery(docs: DataFrame, headings: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """Adds ``needs_outline_recovery``: a PDF with fewer headings than asked for. ``docs``: keys, format."""
    counts = headings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(counts, keys, "left").withColumn(
        "needs_outline_recovery", (F.col("format") == "pdf") & (F.coalesce("_n", F.lit(0)) < minimum)).drop("_n")


def locate_bookmarks(bookmarks: DataFrame, lines: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Bookmark headings at the first line of their page that holds the title, else at the page start.

    ``bookmarks``: keys, seq, title, level, page. ``pages``: keys, page, start. A page outside the document is
    ``E_PDF_OUTLINE``; blank titles are skipped.
    """
    named = bookmarks.filter(~blank(F.col("title")))
    hits = (named.join(lines.select(*keys, "page", F.col("seq").alias("_line"), F.col("text"), F.col("position").alias("_at")), [*keys, "page"])
            .filter(F.contains("text", F.col("title"))).groupBy(*keys, "seq").agg(F.min_by("_at", "_line").alias("_found")))
    rows = named.join(pages.select(*keys, "page", "start"), [*keys, "page"], "left").join(hits, [*keys, "seq"], "left")
    return rows.select(*keys, "seq", F.concat(F.lit("bookmark_"), F.col("seq").cast("string")).alias("id"), F.col("title").alias("text"), "level",
                       F.coalesce("_found", "start").alias("position"), F.when(F.col("start").isNull(), "E_PDF_OUTLINE").alias("code"))


def table_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Column headers of each table: the first row flagged as header, else the first row, cells in order.

    ``cells``: keys, table_id, row, col, text, header_row, position (of the table).
    """
    table = [*keys, "table_id"]
    whole = W.partitionBy(*table)
    picked = F.coalesce(F.min(F.when(F.col("header_row"), F.col("row"))).over(whole), F.min("row").over(whole))
    return (cells.withColumn("_row", picked).filter("row = _row").groupBy(*table)
            .agg(F.min("position").alias("position"), F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("headers")))


def tagged_table_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tagged tables: header cells in reading order, row headers left out; position of the earliest content.

    ``cells``: keys, table_id, seq, role (``TH``/``TD``), scope, text, position. Tables without content vanish.
    """
    header = (F.col("role") == "TH") & ~F.coalesce(F.col("scope") == "Row", F.lit(False))
    listed = F.array_sort(F.collect_list(F.when(header, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    return (cells.groupBy(*keys, "table_id").agg(F.min("position").alias("position"), F.transform(listed, lambda c: c["text"]).alias("headers"))
            .filter("position is not null"))


def assemble_full_text(pieces: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Documents from ordered pieces: ``full_text`` and ``items`` (pieces with their positions).

    ``pieces``: keys, seq, kind (``marker`` or other), text. Blank pieces other than markers are dropped; text is
    joined by newlines. A document is one row, so offsets are computed inside it.
    """
    carry = carry or []
    # an anchor (a table start) takes the position of what follows and adds nothing
    kept = pieces.filter(F.col("kind").isin("marker", "anchor") | ~blank(F.col("text")))
    grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text", *carry))).alias("_p"))
    starts = running_offsets(F.transform("_p", lambda p: F.when(p["kind"] == "anchor", F.lit(0).cast("bigint")).otherwise(utf16_len(p["text"]) + 1)))
    items = F.zip_with("_p", starts, lambda p, s: F.struct(*[p[c].alias(c) for c in ("seq", "kind", "text", *carry)], s.alias("position")))
    shown = F.transform(F.filter("_p", lambda p: p["kind"] != "anchor"), lambda p: p["text"])
    return grouped.select(*keys, F.array_join(shown, "\n").alias("full_text"), items.alias("items"))


def phrases(vocabulary: Column) -> Column:
    """Each term as a phrase of whole words, ready to be searched; empty terms are left out."""
    return F.filter(F.transform(vocabulary, token_phrase), lambda p: F.length(p) > 0)


def structural(text: Column, vocabulary_phrases: Column) -> Column:
    """Some vocabulary term occurs as whole consecutive words."""
    return let(token_phrase(text), lambda t: F.exists(vocabulary_phrases, lambda p: F.contains(t, p)))


def match_structural(headings: DataFrame, packs: DataFrame, pack_key: str) -> DataFrame:
    """Adds ``structural`` to headings. ``packs``: pack key, vocabulary (array); a pack's list is one row, made ready once."""
    ready = packs.select(pack_key, phrases(F.col("vocabulary")).alias("_phrases"))
    return headings.join(ready, pack_key).withColumn("structural", structural(F.col("text"), F.col("_phrases"))).drop("_phrases")


def vocabulary_collisions(packs: DataFrame, types: DataFrame, pack_key: str) -> DataFrame:
    """Terms that share a word with a type's name, definition or examples. Token equi join, then distinct."""
    terms = packs.select(pack_key, F.explode("vocabulary").alias("term")).distinct()
    terms = terms.select(pack_key, "term", F.explode(F.array_distinct(words_nfkc(F.col("term")))).alias("_token"))
    fields = F.concat(F.array("name", "what"), F.coalesce("examples", F.array().cast("array<string>")))
    tokens = types.select(pack_key, F.col("id").alias("type_id"), F.explode(F.array_distinct(words_nfkc(F.array_join(fields, "\n")))).alias("_token"))
    return terms.join(tokens, [pack_key, "_token"]).select(pack_key, "term", "type_id").distinct().withColumn("code", F.lit("E_VOCABULARY_COLLISION"))


def outline_notes(docs: DataFrame, marked_headings: DataFrame, keys: list[str]) -> DataFrame:
    """``N_NO_OUTLINE`` without headings, ``N_NO_STRUCTURAL_SECTIONS`` when none is structural."""
    found = marked_headings.groupBy(*keys).agg(F.bool_or("structural").alias("_any"))
    note = F.when(F.col("_any").isNull(), "N_NO_OUTLINE").when(~F.col("_any"), "N_NO_STRUCTURAL_SECTIONS")
    return docs.select(*keys).join(found, keys, "left").select(*keys, note.alias("note")).filter("note is not null")


def validate_outline(headings: DataFrame, tables: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Violation rows ``keys, part, problem, position``."""
    def rows(df: DataFrame, part: str, problem: str) -> DataFrame:
        return df.select(*keys, F.lit(part).alias("part"), F.lit(problem).alias("problem"), F.col("position").cast("bigint").alias("position"))
    bad_position = F.coalesce(~F.col("position").between(0, k.MAX_SAFE_INTEGER), F.lit(True))
    repeated = headings.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"), F.max("position").alias("position")).filter("_n > 1 and length(id) > 0")
    dangling = blocks.filter("heading_id is not null").join(headings.select(*keys, F.col("id").alias("heading_id")), [*keys, "heading_id"], "left_anti")
    parts = [
        rows(headings.filter(F.coalesce(F.length("id") == 0, F.lit(True))), "heading", "empty_id"),
        rows(repeated, "heading", "duplicate_id"),
        rows(headings.filter(F.coalesce(F.length("text") == 0, F.lit(True))), "heading", "empty_text"),
        rows(headings.filter(F.coalesce(F.col("level") < 1, F.lit(True))), "heading", "level"),
        rows(headings.filter(bad_position), "heading", "position"),
        rows(tables.filter(bad_position), "table", "position"),
        rows(tables.filter(F.exists("headers", lambda h: h.isNull())), "table", "header"),
        rows(blocks.filter(bad_position), "block", "position"),
        rows(blocks.filter("text is null"), "block", "text"),
        rows(dangling, "block", "heading_reference"),
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def reader_context_check(docs: DataFrame, packs: DataFrame, pack_key: str) -> DataFrame:
    """``E_READER_CONTEXT`` when a known input plus the output cap exceeds the context; unknown counts pass.

    ``docs``: pack key, reader_input_tokens. ``packs``: pack key, reader_max_output_tokens, reader_context_tokens.
    """
    over = F.col("reader_input_tokens") + F.col("reader_max_output_tokens") > F.col("reader_context_tokens")
    return docs.join(packs.select(pack_key, "reader_max_output_tokens", "reader_context_tokens"), pack_key).withColumn(
        "code", F.when(over, "E_READER_CONTEXT")).drop("reader_max_output_tokens", "reader_context_tokens")


def mixed_extractor_note(docs: DataFrame) -> DataFrame:
    """The note for every document of a run whose documents carry more than one extractor version.

    Smallest and largest version differ exactly when there is more than one, which needs no distinct shuffle.
    """
    mixed = (docs.filter("length(extractor_version) > 0").groupBy("run_id")
             .agg(F.min("extractor_version").alias("_a"), F.max("extractor_version").alias("_b")).filter("_a <> _b").select("run_id"))
    return docs.join(mixed, "run_id", "left_semi").select("run_id", "fingerprint", F.lit("N_EXTRACTOR_VERSION_MIXED").alias("note"))

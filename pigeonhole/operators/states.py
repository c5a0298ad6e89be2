"""Model input states: complete text with its outline, the older sectioned state, and the budgeted digest."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.arrays import running_offsets
from pigeonhole.functions.json import let
from pigeonhole.functions.text import utf16_len
from pigeonhole.operators.outline import phrases, structural

HEADING = "struct<id:string,text:string,level:int,position:bigint>"
NO_NULLS = {"ignoreNullFields": "false"}


def json_text(value: Column) -> Column:
    """JSON text as ``JSON.stringify`` writes it: nulls kept, and control characters in lower-case hex."""
    raw = F.to_json(value, NO_NULLS)

    def lower(c: Column) -> Column:
        for letter in "ABCDEF":
            c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*)\\u00([01]){letter}", rf"$1\\u00$2{letter.lower()}")
        return c
    return let(raw, lambda r: F.when(r.rlike(r"\\u00[01][A-F]"), lower(r)).otherwise(r))


def nest_outline(docs: DataFrame, headings: DataFrame, tables: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Outline arrays per document in position order (input order on ties). Only outline rows are grouped."""
    ordered = lambda df, *cols: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "seq", *cols))).alias("_v"))
    part = lambda df, name, item, *cols: ordered(df, *cols).select(*keys, F.transform("_v", item).alias(name))
    h = part(headings, "headings", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["level"].cast("int").alias("level"), x["position"].cast("bigint").alias("position")), "id", "text", "level")
    t = part(tables, "tables", lambda x: F.struct(x["position"].cast("bigint").alias("position"), x["headers"].alias("headers")), "headers")
    b = part(blocks, "blocks", lambda x: F.struct(x["heading_id"].alias("headingId"), x["position"].cast("bigint").alias("position"), x["text"].alias("text")), "heading_id", "text")
    empty = lambda t_: F.array().cast(f"array<{t_}>")
    return (docs.join(h, keys, "left").join(t, keys, "left").join(b, keys, "left").withColumns({
        "headings": F.coalesce("headings", empty(HEADING)), "tables": F.coalesce("tables", empty("struct<position:bigint,headers:array<string>>")),
        "blocks": F.coalesce("blocks", empty("struct<headingId:string,position:bigint,text:string>"))}))


def _first_text(array: str) -> Column:
    return F.try_element_at(array, F.lit(1))["text"]


def resolve_title(policy: Column) -> Column:
    """Title per policy: given, else first heading, else (older policies) first block, else full text or null."""
    base = F.coalesce(F.col("title"), _first_text("headings"))
    return (F.when(policy == k.STATE_V3, base)
            .when(policy == k.STATE_V2, F.coalesce(base, _first_text("blocks"), F.col("full_text")))
            .when(policy == k.DIGEST_V1, F.coalesce(base, _first_text("blocks"))))


def compact_state() -> Column:
    return json_text(F.struct(F.col("full_text").alias("fullText"), resolve_title(F.lit(k.STATE_V3)).alias("title"), "headings", "tables"))


def structured_state() -> Column:
    return json_text(F.struct(F.col("full_text").alias("fullText"), resolve_title(F.lit(k.STATE_V2)).alias("title"), "headings", "tables",
                              F.col("blocks").alias("sections")))


def build_compact_state(docs: DataFrame) -> DataFrame:
    """Complete text, title, headings and tables as one JSON text; block text is not repeated."""
    return docs.withColumn("serialized", compact_state())


def build_structured_state(docs: DataFrame) -> DataFrame:
    """As the compact state, with every block as a section."""
    return docs.withColumn("serialized", structured_state())


def build_confidence_state(docs: DataFrame, policy: str = "state_policy") -> DataFrame:
    """The state named by each row's frozen policy; an unknown policy raises.

    A document without text is named in ``code`` beside its state, so that it doesn't stop the job of all others.
    """
    p = F.col(policy)
    state = (F.when(p == k.STATE_V3, compact_state()).when(p == k.STATE_V2, structured_state())
             .otherwise(F.raise_error(F.concat(F.lit("Unknown state policy: "), F.coalesce(p, F.lit("none"))))))
    return docs.withColumns({"serialized": state, "code": F.when(F.coalesce(F.length("full_text"), F.lit(0)) == 0, "E_NO_TEXT")})


def ordered_blocks() -> Column:
    """Blocks in digest order: structural headings first, then other headings, then unattached blocks."""
    marked = let(phrases(F.col("vocabulary")), lambda terms: F.transform("headings", lambda h, i: F.struct(
        h["id"].alias("id"), i.alias("rank"), (~structural(h["text"], terms)).cast("int").alias("group"))))

    def with_order(m: Column) -> Column:
        def key(b: Column, i: Column) -> Column:
            at = F.nullif(F.array_position(F.transform(m, lambda x: x["id"]), b["headingId"]), F.lit(0))
            home = F.try_element_at(m, at.cast("int"))
            return F.struct(F.coalesce(home["group"], F.lit(2)).alias("g"), F.coalesce(home["rank"], F.lit(0)).alias("r"), i.alias("i"), b.alias("b"))
        return F.transform(F.array_sort(F.transform("blocks", key)), lambda x: x["b"])
    return F.when(F.size("headings") == 0, F.col("blocks")).otherwise(let(marked, with_order))


def _fitting(text: Column, room: Column) -> Column:
    """Code points of the longest prefix that takes at most ``room`` inside JSON text.

    A character takes one at least, so no more than ``room`` of them are looked at; where some of those are escaped, the
    length is found by halving.
    """
    fits = lambda n: F.length(json_text(F.array(F.substring(text, F.lit(1), n)))) - 4 <= room

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"] + 1) / 2).cast("int")
        step = let(middle, lambda m: F.when(fits(m), F.struct(m.alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), (m - 1).alias("high"))))
        return F.when(a["low"] < a["high"], step).otherwise(a)

    def search(most: Column) -> Column:
        start = F.struct(F.lit(0).alias("low"), most.alias("high"))
        return F.when(fits(most), most).otherwise(F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(most + 1)).cast("int")), start, halve, lambda a: a["low"]))
    return let(F.greatest(F.least(F.length(text).cast("bigint"), room), F.lit(0)).cast("int"), search)


def build_budgeted_digest(docs: DataFrame) -> DataFrame:
    """Budgeted digest with the built-in codec (one token per code point), entirely inside the row.

    Input adds ``vocabulary`` and ``budget`` to the nested outline. Title, headings and tables must fit; blocks are
    taken whole in digest order until one does not fit, which leaves its longest fitting prefix and ends the digest.
    Adds serialized, token_count, sections, taken (UTF-16 length kept per ordered block) and code.
    """
    title = resolve_title(F.lit(k.DIGEST_V1))
    state = lambda sections: json_text(F.struct(title.alias("title"), "headings", "tables", sections.alias("sections")))
    none = F.array().cast("array<struct<headingId:string,position:bigint,text:string>>")

    def sections_for(blocks: Column, room: Column) -> Column:
        shell = lambda b: F.length(json_text(F.struct(b["headingId"].alias("headingId"), b["position"].alias("position"), F.lit("").alias("text")))).cast("bigint")
        # every section after the first adds a comma; an empty block is never written
        costs = F.transform(blocks, lambda b: F.when(F.length(b["text"]) == 0, F.lit(0).cast("bigint")).otherwise(
            shell(b) + F.length(json_text(F.array(b["text"]))) - 4 + 1))

        def cut_at(cost: Column, start: Column) -> Column:
            # the comma is charged to every section, so the room is one larger for the first
            over = F.array_position(F.zip_with(cost, start, lambda c, s: (s + c > room + 1) & (c > 0)), F.lit(True))

            def result(o: Column) -> Column:
                whole = F.when(o == 0, blocks).otherwise(F.slice(blocks, F.lit(1), F.greatest(o - 1, F.lit(0)).cast("int")))
                last = F.try_element_at(blocks, F.greatest(o, F.lit(1)).cast("int"))
                left = room + 1 - F.try_element_at(start, F.greatest(o, F.lit(1)).cast("int")) - shell(last) - 1
                prefix = F.when(o > 0, F.substring(last["text"], F.lit(1), _fitting(last["text"], left)))

                def parts(p: Column) -> Column:
                    partial = F.when(F.length(p) > 0, F.array(F.struct(last["headingId"].alias("headingId"), last["position"].alias("position"), p.alias("text")))).otherwise(none)
                    lengths = F.transform(blocks, lambda b, i: F.when((o == 0) | (i < o - 1), utf16_len(b["text"])).when(
                        i == o - 1, F.coalesce(utf16_len(p), F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
                    return F.struct(F.concat(F.filter(whole, lambda b: F.length(b["text"]) > 0), partial).alias("sections"), lengths.alias("taken"))
                return let(prefix, parts)
            return let(over, result)
        return let(costs, lambda c: let(running_offsets(c), lambda s: cut_at(c, s)))

    base = F.length(state(none)).cast("bigint")
    chosen = let(ordered_blocks(), lambda blocks: let(base, lambda n: F.struct(
        n.alias("base"), blocks.alias("blocks"), sections_for(blocks, F.col("budget") - n).alias("s"))))
    code = (F.when(title.isNull(), "E_DIGEST_STATE").when(F.col("_d.base") > F.col("budget"), "E_DIGEST_OUTLINE_BUDGET"))
    rows = docs.withColumn("_d", chosen).withColumn("code", code)
    ok = F.col("code").isNull()
    rows = rows.withColumns({"sections": F.when(ok, F.col("_d.s.sections")), "taken": F.when(ok, F.col("_d.s.taken")), "digest_blocks": F.col("_d.blocks")})
    return rows.withColumn("serialized", F.when(ok, state(F.col("sections")))).withColumn("token_count", F.length("serialized")).drop("_d")


class Codec(Protocol):
    """A caller's tokenizer: an id, a count, and the longest literal prefix that fits."""

    id: str

    def count(self, text: str) -> int: ...

    def prefix(self, text: str, fits) -> str: ...


def build_digest_with_codec(docs: DataFrame, codec: Codec, keys: list[str]) -> DataFrame:
    """Budgeted digest under a caller's codec: one Python call per document, batched by Arrow, no shuffle."""
    import json

    head = json_text(F.struct(resolve_title(F.lit(k.DIGEST_V1)).alias("title"), "headings", "tables"))
    rows = docs.select(*keys, "budget", head.alias("_head"), json_text(ordered_blocks()).alias("_blocks"))
    schema = rows.select(*keys).schema.simpleString()[7:-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dump = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        for frame in frames:
            out = []
            for budget, head_text, blocks in zip(frame["budget"], frame["_head"], frame["_blocks"]):
                state, sections = json.loads(head_text), []
                full = lambda s: codec.count(dump({**state, "sections": s}))
                if full([]) > budget:
                    out.append((None, None, "E_DIGEST_OUTLINE_BUDGET"))
                    continue
                for block in (b for b in json.loads(blocks) if b["text"]):
                    fits = lambda t, b=block: full([*sections, {**b, "text": t}]) <= budget
                    if fits(block["text"]):
                        sections.append(block)
                        continue
                    kept = codec.prefix(block["text"], fits)
                    if kept:
                        sections.append({**block, "text": kept})
                    break
                text = dump({**state, "sections": sections})
                out.append((text, codec.count(text), None))
            yield frame[keys].assign(**dict(zip(("serialized", "token_count", "code"), map(list, zip(*out)))) if out else {"serialized": [], "token_count": [], "code": []})

    return rows.mapInPandas(run, f"{schema},serialized string,token_count bigint,code string")


class CodePoints:
    """One token per code point; the reference codec for tests."""

    id = "code-points"

    def count(self, text: str) -> int:
        return len(text)

    def prefix(self, text: str, fits) -> str:
        low, high = 0, len(text)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(text[:middle]) else (low, middle - 1)
        return text[:low]


def selection_log(docs: DataFrame, keys: list[str], policy: str = "state_policy") -> DataFrame:
    """What each state contains: headings, blocks with kept and omitted UTF-16 lengths, and for the compact state
    the full text and tables. ``docs`` are nested outlines; digest rows also carry ``digest_blocks`` and ``taken``."""
    p = F.col(policy)
    entry = "struct<kind:string,heading_id:string,position:bigint,original:bigint,included:bigint,headers:int>"
    null = lambda t: F.lit(None).cast(t)

    def make(kind: str, heading_id=None, position=None, original=None, included=None, headers=None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (heading_id if heading_id is not None else null("string")).alias("heading_id"),
                        (position if position is not None else null("bigint")).alias("position"),
                        (original if original is not None else null("bigint")).alias("original"),
                        (included if included is not None else null("bigint")).alias("included"),
                        (headers if headers is not None else null("int")).alias("headers"))
    none = F.array().cast(f"array<{entry}>")
    headings = F.transform("headings", lambda h: make("heading", h["id"], h["position"]))
    full = F.array(make("full_text", original=utf16_len(F.col("full_text")), included=utf16_len(F.col("full_text"))))
    tables = F.transform("tables", lambda t: make("table", position=t["position"], headers=F.size(t["headers"])))
    blocks = F.transform("blocks", lambda b: make("block", position=b["position"], original=utf16_len(b["text"]), included=utf16_len(b["text"])))
    cut = none
    if {"digest_blocks", "taken"} <= set(docs.columns):
        cut = F.zip_with("digest_blocks", "taken", lambda b, n: make("block", position=b["position"], original=utf16_len(b["text"]), included=n))
    log = (F.when(p == k.STATE_V3, F.concat(full, headings, tables)).when(p == k.STATE_V2, F.concat(headings, blocks))
           .when(p == k.DIGEST_V1, F.concat(headings, F.coalesce(cut, none))))
    return (docs.select(*keys, F.posexplode(log).alias("log_index", "e")).select(*keys, "log_index", "e.*")
            .withColumn("omitted", F.col("original") - F.col("included")))

"""Chunks from blocks: tables and runs of steps stay whole, paragraphs are packed to a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, LongType

from docmill.config import DEFAULT_CODE_PATTERNS, ChunkingConfig
from docmill.functions.codes import extract
from docmill.functions.text import strip
from docmill.session import stored


#: Orders of one tile, which is the most that one row of packing holds.
TILE = 4096


@F.pandas_udf(ArrayType(LongType()))
def tile_exits(lengths: pd.Series, budget: pd.Series) -> pd.Series:
    """What a tile does to greedy packing, for every place at which a group may begin in it first.

    A tile's first group begins at the first block that exceeds what is left of the group before, so only places
    matter before which the blocks fit a whole budget. For such a place j: ``fits``, what blocks 0 to j come to; ``used``
    and ``begun``, the length of the group left open and the number of groups begun, if the first begins at j. They are
    found from the tile's end, by the next group's. The result is the tile's length, the number of places, and then
    fits, used and begun of them all."""
    out = []
    for own, most in zip(lengths, budget, strict=True):
        total = np.concatenate([[0], np.cumsum(np.asarray(own, np.int64))])
        n = len(own)
        # a group from j ends before the first block that exceeds the budget, and holds block j whatever its length
        ends = np.maximum(np.searchsorted(total, total[:-1] + most, "right") - 1, np.arange(1, n + 1))
        used, begun = [0] * n, [0] * n
        for j in range(n - 1, -1, -1):
            e = int(ends[j])
            used[j], begun[j] = (int(total[n] - total[j]), 1) if e >= n else (used[e], begun[e] + 1)
        last = min(n, int(np.searchsorted(total[1:], most, "right")) + 1)
        out.append([int(total[n]), last, *total[1 : last + 1].tolist(), *used[:last], *begun[:last]])
    return pd.Series(out)


@F.pandas_udf(ArrayType(LongType()))
def tile_starts(exits: pd.Series, budget: pd.Series) -> pd.Series:
    """Length of the open group and groups begun before each tile of a run, one after the other, from the exits
    of its tiles in order, one after the other."""
    out = []
    for told, most in zip(exits, budget, strict=True):
        used, begun, at, states = 0, 0, 0, []
        while at < len(told):
            states += [used, begun]
            whole, n = told[at], told[at + 1]
            fits, held, count = (told[at + 2 + k * n : at + 2 + (k + 1) * n] for k in range(3))
            # nothing is open before the first tile, so its first block begins a group
            first = int(np.searchsorted(fits, most - used, "right")) if begun else 0
            used, begun = (held[first], begun + count[first]) if first < n else (used + whole, begun)
            at += 2 + 3 * n
        out.append(states)
    return pd.Series(out)


def _greedy(lengths, most: int, used: int, begun: int) -> list[int]:
    numbers = []
    for n in lengths:
        if begun == 0 or used + n > most:
            begun, used = begun + 1, 0
        used += n
        numbers.append(begun - 1)
    return numbers


@F.pandas_udf(ArrayType(IntegerType()))
def greedy_groups(lengths: pd.Series, budget: pd.Series) -> pd.Series:
    """Group number of each block: a block that would exceed the budget begins the next group."""
    return pd.Series([_greedy(own, most, 0, 0) for own, most in zip(lengths, budget, strict=True)])


@F.pandas_udf(ArrayType(LongType()))
def tile_groups(lengths: pd.Series, budget: pd.Series, used: pd.Series, begun: pd.Series) -> pd.Series:
    """``greedy_groups`` of a tile before which ``begun`` groups were begun, the last of them of length ``used``."""
    return pd.Series([_greedy(*one) for one in zip(lengths, budget, used, begun, strict=True)])


def chunk_id(document: Column, ordinal: Column, page: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", document.cast("string"), ordinal.cast("string"), page.cast("string"), text)), 1, 16)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def embedding_text(section: Column, text: Column) -> Column:
    return F.when(F.length(section) > 0, F.concat(section, F.lit("\n"), text)).otherwise(text)


def pack(blocks: DataFrame, keys: list[str], order: str, length: Column, budget: Column, tile: int = TILE) -> DataFrame:
    """Adds group to blocks: greedy packing in order within the keys; a block over budget stands alone.

    The order has to be a whole number, each once within the keys; a null length
    counts nothing, and rows with a null key or order go. Tiles of neighbouring
    orders are rows of their own, so a run of any length is spread over tasks: each tile tells what it does to the
    open group, which takes a few numbers, the tiles of a run are gone through in order on these, and then each
    tile numbers its groups.
    """
    part = F.floor(F.col(order) / tile)
    own = blocks.groupBy(*keys, part.alias("_tile")).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(length, F.lit(0)).cast("long").alias("n")))).alias("own"), F.first(budget).cast("long").alias("most"))
    lengths = F.transform("own", lambda x: x["n"])
    told = own.select(*keys, "_tile", "most", tile_exits(lengths, F.col("most")).alias("exits"))
    runs = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_tile", "exits"))).alias("tiles"), F.first("most").alias("most"))
    runs = runs.withColumn("states", tile_starts(F.flatten(F.transform("tiles", lambda x: x["exits"])), F.col("most")))
    begins = runs.select(*keys, "states", F.posexplode(F.transform("tiles", lambda x: x["_tile"])).alias("k", "_tile"))
    begins = begins.select(*keys, "_tile", F.get("states", F.col("k") * 2).alias("_used"), F.get("states", F.col("k") * 2 + 1).alias("_begun"))
    own = own.join(begins, [*keys, "_tile"]).withColumn("group", tile_groups(lengths, F.col("most"), F.col("_used"), F.col("_begun")))
    numbers = own.select(*keys, "_tile", F.explode(F.arrays_zip(F.transform("own", lambda x: x[order]).alias("o"), F.col("group").alias("g"))).alias("z"))
    numbers = numbers.select(*keys, "_tile", F.col("z")["o"].alias(order), F.col("z")["g"].alias("group"))
    return blocks.withColumn("_tile", part).join(numbers, [*keys, "_tile", order]).drop("_tile")


def chunks(blocks: DataFrame, key: str, config: ChunkingConfig | None = None, rules=DEFAULT_CODE_PATTERNS) -> DataFrame:
    """(key, ordinal, chunk_id, text, page, section, kind, rows, codes) of blocks as ``blocks.blocks`` makes them.

    Blocks of one sort with no other sort between them are packed together: they have seen the same number of lines of
    other sorts. The blocks are stored once; packing and numbering go by their lengths, and texts join at the end.
    """
    config = config or ChunkingConfig()
    kind, seen = F.col("kind"), F.col("seen")
    text = ["paragraph"] + ([] if config.keep_tables_intact else ["table"]) + ([] if config.keep_steps_intact else ["step"])
    others = sum((seen[k] for k in ("heading", "table", "step") if k not in text), F.lit(0))
    sort = F.when(kind.isin(*text), "text").when(kind == "step", "steps").otherwise(kind)
    segment = F.when(sort == "text", others).when(sort == "steps", seen["heading"] + seen["table"] + seen["paragraph"]).otherwise(F.col("island"))
    sized = blocks.where("kind <> 'heading'").select(
        key, "island", "kind", "text", "page", "section", "rows", sort.alias("sort"), segment.alias("segment"), F.length("text").alias("chars"), (strip(F.col("text")) != "").alias("solid")
    )
    sized = stored(sized, "blocks")
    part = [key, "sort", "segment"]
    budget = F.when(F.col("sort") == "steps", config.step_max_chars).otherwise(config.max_chars)
    packed = pack(sized.select(*part, "island", "chars", "solid"), part, "island", F.col("chars"), budget)
    heads = packed.groupBy(*part, "group").agg(F.min("island").alias("head"), F.bool_or("solid").alias("any")).where("any").drop("any")
    heads = heads.withColumn("ordinal", F.row_number().over(W.partitionBy(key).orderBy("head")) - 1).drop("head")
    own = packed.join(heads, [*part, "group"]).select(key, "island", "ordinal").join(sized, [key, "island"])
    made = own.groupBy(key, "ordinal").agg(
        F.sort_array(F.collect_list(F.struct("island", "text"))).alias("own"),
        F.min_by("page", "island").alias("page"),
        F.min_by("section", "island").alias("section"),
        F.min_by("rows", "island").alias("rows"),
        F.when(F.bool_or(kind == "table"), "table").when(F.bool_and(kind == "step"), "step").otherwise("paragraph").alias("kind"),
    )
    made = made.withColumn("text", strip(F.array_join(F.transform("own", lambda x: x["text"]), "\n")))
    return made.select(
        key, "ordinal", chunk_id(F.col(key), F.col("ordinal"), F.col("page"), F.col("text")).alias("chunk_id"), "text", "page", "section", "kind",
        F.when(F.col("kind") == "table", F.col("rows")).alias("rows"), extract(F.concat_ws("\n", "section", "text"), rules).alias("codes"),
    )

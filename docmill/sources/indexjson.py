"""An index as one JSON document, read and written by many tasks.

The document has ``version`` (1 or 2), ``metadata`` (with the registry as ``documents``), ``chunks`` (an array) and
``vectors`` (an object of arrays by chunk id). It is a file, or a folder whose files, in the order of their names, are
its text; ``write_index_json`` makes either.

**Reading in ranges.** The text source cuts the bytes at commas, so every task has a range of the file wherever the
entries lie. A first pass notes for each range how many quotes it has, how deep its brackets lead from both possible
starts (in a string or not), and the last keys it leaves open: one row a range, which the driver adds up to the state
in which each range begins. The second pass cuts every range into entries. Only an entry that crosses a range's end is
put together by a shuffle, at most two parts a range.

Any layout and order of keys is read. Where an id comes twice the last one counts, as in a JSON object. Unknown keys
are left out. A missing ``metadata``, as in version 1, gives an empty registry and empty names. A text that ends inside
a value, another version, or an entry that is no JSON is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docmill.session import bound_batches, shared_folder
from docmill.sources.documents import stem

CODE = "struct<kind:string,value:string,raw:string>"
CHUNK = f"struct<chunk_id:string,document_id:string,source_path:string,text:string,page:int,section:string,kind:string,codes:array<{CODE}>,rows:array<array<string>>>"
DOCUMENT = "struct<source_path:string,document_id:string,title:string,content_hash:string,chunk_count:long>"
#: Version that is written.
VERSION = 2
_STRUCTURE = np.zeros(256, np.int8)
for _sign, _kind in (("{", 1), ("[", 1), ("}", -1), ("]", -1), (",", 2), (":", 3)):
    _STRUCTURE[ord(_sign)] = _kind


def _signs(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, kind, depth, quotes): brackets, commas and colons outside strings with the depth after each, from 0,
    and the quotes that begin or end a string."""
    quotes = np.flatnonzero(data == 34)
    back = data == 92
    if len(quotes) and back.any():
        last = np.maximum.accumulate(np.where(back, -1, np.arange(len(data), dtype=np.int64)))
        run = np.where(quotes > 0, quotes - 1 - last[quotes - 1], 0)
        quotes = quotes[run % 2 == 0]
    at = np.flatnonzero(_STRUCTURE[data])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    kind = _STRUCTURE[data[at]]
    return at, kind, np.cumsum(np.where(np.abs(kind) == 1, kind, 0)), quotes


def _key(data: np.ndarray, quotes: np.ndarray, colon: int) -> str:
    """The string before a colon; the keys that matter here hold no comma, so they are never cut by a range."""
    k = int(np.searchsorted(quotes, colon))
    return data[quotes[k - 2] + 1 : quotes[k - 1]].tobytes().decode("utf-8", "replace") if k >= 2 else "?"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, start of its range), bytes) of each batch's rows, with the commas between them."""
    for batch in batches:
        files, starts, values = batch.column(0), batch.column(1), batch.column(2)
        # rows are joined where they lie in Arrow's memory; a range's rows are neighbours
        moved = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1])) if len(batch) > 1 else pa.array([], pa.bool_())
        cut = [0, *(np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values[a:b]), b",")[0].as_buffer().to_pybytes() + b","
                yield (files[a].as_py(), starts[a].as_py()), np.frombuffer(text, np.uint8)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: its quotes' parity and, from either start, its change of depth and last keys by depth."""
    out: dict[tuple[str, int], list[dict]] = {}
    for place, data in _ranges(batches):
        own = out.setdefault(place, [{"inside": s, "depth": 0, "keys": {}, "n": 0} for s in (0, 1)])
        for state in own:
            at, kind, depth, quotes = _signs(data, state["inside"])
            depth = depth + state["depth"]
            colons = np.flatnonzero((kind == 3) & (depth <= 2))
            for d in np.unique(depth[colons]):
                last = colons[depth[colons] == d][-1]
                state["keys"][int(d)] = (state["n"] + int(at[last]), _key(data, quotes, int(at[last])))
            state["n"] += len(data)
            state["depth"] = int(depth[-1]) if len(depth) else state["depth"]
            state["inside"] = (state["inside"] + len(quotes)) % 2
    rows = [{"file": f, "start": s, "state": json.dumps(own)} for (f, s), own in out.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("start", pa.int64()), ("state", pa.string())]))


def _begins(surveyed: list) -> dict[tuple[str, int], tuple]:
    """(number, inside, depth, first key, second key) with which each range begins; an error if the last one ends
    inside a value."""
    begins, inside, depth, one, two = {}, 0, 0, None, None
    for number, row in enumerate(sorted(surveyed, key=lambda r: (r["file"], r["start"]))):
        begins[(row["file"], row["start"])] = (number, inside, depth, one, two)
        own = json.loads(row["state"])[inside]
        first, second = own["keys"].get(str(1 - depth)), own["keys"].get(str(2 - depth))
        if first:
            one, two = first[1], second[1] if second and second[0] > first[0] else None
        elif second:
            two = second[1]
        inside, depth = own["inside"], depth + own["depth"]
    if inside or depth:
        raise ValueError("the JSON text ends inside a value")
    return begins


def _level(one: str | None, two: str | None) -> int:
    """Depth whose members are entries: the registry lies one deeper than chunks, vectors and names."""
    return 3 if one == "metadata" and two == "documents" else 2


def _entries(begins: dict[tuple[str, int], tuple]):
    """Cuts ranges into (block, place, section, text, opens, closes); an entry that crosses a range's end has
    opens or closes false in the parts that lack its start or end."""

    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("section", pa.string()), ("text", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_())])

    def section(one: str | None, two: str | None) -> str:
        return "documents" if _level(one, two) == 3 else str(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, one, two, rest, opens, made = None, 0, 0, None, None, [], True, 0
        for place, data in _ranges(batches):
            rows = []
            if place != now:
                if rest:
                    rows.append((number, made, section(one, two), b"".join(rest), opens, False))
                now, rest, made = place, [], 0
                number, inside, depth, one, two = begins[place]
                opens = not inside and depth <= _level(one, two)
            at, kind, after, quotes = _signs(data, inside)
            after = after + depth
            before = after - np.where(np.abs(kind) == 1, kind, 0)
            # spans of one first and second key; only metadata's second keys matter
            spans = [(0, one, two)]
            for k in np.flatnonzero((kind == 3) & (after <= 2)):
                if after[k] == 1:
                    one, two = _key(data, quotes, int(at[k])), None
                elif after[k] == 2 and one == "metadata":
                    two = _key(data, quotes, int(at[k]))
                else:
                    continue
                spans.append((int(k), one, two))
            first = 0
            for (low, a, b), high in zip(spans, [s[0] for s in spans[1:]] + [len(at)], strict=True):
                cuts = low + np.flatnonzero((kind[low:high] != 3) & (np.maximum(before[low:high], after[low:high]) <= _level(a, b)))
                for k in cuts:
                    text = data[first : at[k]].tobytes()
                    first = int(at[k]) + 1
                    if rest:
                        text, rest = b"".join([*rest, text]), []
                    if kind[k] != 1 and (text.strip() or not opens):  # what an opening bracket ends is a name
                        rows.append((number, made, section(a, b), text, opens, True))
                        made += 1
                    opens = True
            if first < len(data):
                rest.append(data[first:].tobytes())
            depth = int(after[-1]) if len(after) else depth
            inside = (inside + len(quotes)) % 2
            if rows:
                yield _batch(rows)
        if rest:
            yield _batch([(number, made, section(one, two), b"".join(rest), opens, False)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.bool_()], strict=True)]
        columns[3] = columns[3].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def read_index_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """chunks, vectors (chunk_id, v), registry and meta of an index in JSON; the entries are stored in the shared
    folder, so the document is read twice, whatever is done with them."""
    bound_batches(spark)
    text = spark.read.option("lineSep", ",").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    begins = _begins(text.mapInArrow(_survey, "file string, start long, state string").collect())  # a row a range
    at = shared_folder(spark, "index-json")
    kinds = "block long, place long, section string, text string, opens boolean, closes boolean"
    text.mapInArrow(_entries(begins), kinds).write.parquet(at)
    rows = spark.read.schema(kinds).parquet(at)
    # the conditions stand by the texts too, since the optimizer may parse before it filters
    whole = rows.where("opens and closes").select("section", F.expr("case when opens and closes then text end").alias("text"), "block", "place")
    parts = rows.where("not (opens and closes)")
    # the window sees two short rows a range at most
    numbered = parts.select("block", "place", F.sum(F.col("opens").cast("long")).over(W.orderBy("block", "place")).alias("entry"))
    joined = parts.join(numbered, ["block", "place"]).groupBy("entry").agg(
        F.min_by("section", F.struct("block", "place")).alias("section"), F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("own")
    )
    joined = joined.select("section", F.array_join(F.transform("own", lambda p: p["text"]), "").alias("text"), F.col("own")[0]["block"].alias("block"), F.col("own")[0]["place"].alias("place"))
    entries = whole.unionByName(joined)

    member = F.concat(F.lit("{"), "text", F.lit("}"))
    scalars = ("version", "embedding_model", "vector_dim", "created_at", "updated_at")
    said = _parsed(F.when(F.col("section").isin("version", "metadata"), member), "struct<version:int,embedding_model:string,vector_dim:int,created_at:string,updated_at:string>")
    few = entries.where("section in ('version', 'metadata')").select("section", said.alias("x"))
    few = few.agg(*(F.max(F.when(F.col("section") == ("version" if c == "version" else "metadata"), F.col(f"x.{c}"))).alias(c) for c in scalars)).first()
    if few["version"] not in (1, 2):
        raise ValueError(f"index version {few['version']} is not read; 1 or 2 is expected")
    last = lambda of, rows: rows.groupBy(of).agg(F.max_by("x", F.struct("block", "place")).alias("x")).select("x.*")
    part = lambda name, text, schema: entries.where(F.col("section") == name).select("block", "place", _parsed(F.when(F.col("section") == name, text), schema).alias("x"))
    vectors = part("vectors", member, "map<string,array<double>>").select("block", "place", F.explode("x").alias("chunk_id", "v"))
    none = lambda c, kind: F.coalesce(c, F.lit("")) if kind == "text" else F.coalesce(c, F.lit(0).cast("long"))
    registry = part("documents", F.col("text"), DOCUMENT).select("x.*")
    meta = (few["embedding_model"] or "", few["vector_dim"], few["created_at"] or "", few["updated_at"] or "")
    return {
        "chunks": last("x.chunk_id", part("chunks", F.col("text"), CHUNK)),
        "vectors": last("chunk_id", vectors.select("block", "place", "chunk_id", F.struct("chunk_id", "v").alias("x"))),
        "registry": registry.select("source_path", *(none(F.col(c), "text").alias(c) for c in ("document_id", "title", "content_hash")), none(F.col("chunk_count"), "long").alias("chunk_count")),
        "meta": spark.createDataFrame([meta], "embedding_model string, vector_dim int, created_at string, updated_at string"),
    }


def _with(table: DataFrame, /, **defaults: Column) -> DataFrame:
    """The table with these columns, filled in where they are missing or null."""
    return table.withColumns({name: F.coalesce(F.col(name), value) if name in table.columns else value for name, value in defaults.items()})


def write_index_json(spark: SparkSession, index: dict[str, DataFrame], path: str, one_file: bool = False) -> None:
    """Writes what ``lifecycle.load`` gave as one JSON document of version 2: a folder of files that are its text in
    the order of their names, or one file, for which the driver copies their bytes one after the other in bounded
    memory. Entries come by source path and chunk id, of rows that share both the one whose JSON is greatest; the path
    must not exist."""
    meta = index["meta"].first()
    empty = lambda kind: F.lit(None).cast(kind)
    registry, chunks = index["registry"], index["chunks"]
    chunks = _with(chunks, document_id=stem(F.col("source_path")), text=F.lit(""), page=F.lit(1), section=F.lit(""), kind=F.lit("paragraph"), codes=F.array().cast(f"array<{CODE}>"), rows=empty("array<array<string>>"))
    plain = {"ignoreNullFields": "false"}
    fields = lambda schema: [p.split(":")[0] for p in schema[7:-1].replace(CODE, "code").split(",")]
    entry = lambda rows, section, key, text: rows.select(F.lit(section).alias("section"), F.coalesce("source_path", F.lit("")).alias("path"), key.alias("id"), text.alias("text"))
    one_vector = F.to_json(F.create_map(F.col("chunk_id").cast("string"), F.col("v").cast("array<double>")))
    sections = [
        entry(registry, 1, F.lit(""), F.to_json(F.struct(*fields(DOCUMENT)), plain)),
        entry(chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")), 3, F.col("chunk_id"), F.to_json(F.struct(*fields(CHUNK)), plain)),
        entry(index["vectors"].withColumn("t", one_vector), 5, F.col("chunk_id").cast("string"), F.expr("substring(t, 2, length(t) - 2)")),
    ]
    names = json.dumps({k: meta[k] for k in ("embedding_model", "vector_dim", "created_at", "updated_at")})
    frame = [(0, f'{{"version": {VERSION}, "metadata": {names[:-1]}, "documents": ['), (2, ']}, "chunks": ['), (4, '], "vectors": {'), (6, "}}")]
    rows = spark.createDataFrame([(s, "", "", t) for s, t in frame], "section int, path string, id string, text string")
    for section in sections:
        rows = rows.unionByName(section)
    # a comma goes before every entry but a section's first
    keys = [F.col("section"), F.col("path"), F.col("id")]
    heads = rows.where("section in (1, 3, 5)").groupBy("section").agg(F.min(F.struct("path", "id")).alias("head")).collect()
    first = F.lit(False)
    for row in heads:
        first = first | ((keys[0] == row["section"]) & (keys[1] == row["head"]["path"]) & (keys[2] == row["head"]["id"]))
    comma = F.when(keys[0].isin(1, 3, 5) & ~first, F.lit(",")).otherwise(F.lit(""))
    # rows of one key are neighbours by range already, so they meet without a shuffle of their own
    single = rows.repartitionByRange(*keys).groupBy(*keys).agg(F.max("text").alias("text"))
    folder = shared_folder(spark, "index-parts") if one_file else path
    single.sortWithinPartitions(*keys).select(F.concat(comma, "text").alias("value")).write.text(folder)
    if one_file:
        _copy(spark, folder, path)


def _copy(spark: SparkSession, folder: str, path: str) -> None:
    """The folder's files one after the other as one file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path))
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, False)
    try:
        for part in sorted((f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            opened = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, out, 1 << 16, False)
            finally:
                opened.close()
    finally:
        out.close()

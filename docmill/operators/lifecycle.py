"""A versioned index of Parquet tables, updated by content hash.

An index is a folder with a log and segments. A change writes one segment: the chunks, vector blocks and
postings of the documents that it brought, and a registry row for each document that it brought or removed.
A log entry, one small file a version, lists the segments in order; of a document's registry rows the last
counts, and its chunks are those in that row's segment. So a change writes what it changes, whatever the size
of the index, and one that changes nothing writes a log entry alone.

**Tiers.** As soon as ``MOST_SEGMENTS`` neighbours in the list are of one tier, their live rows are written together
as one segment of the next. A document is rewritten once a tier, which is logarithmic in their number.

**Commits.** A change starts from a version and becomes the next one by creating that version's log entry, with
its content, in one step that fails if the entry is there (a hard link on a local file system, a rename that
does not overwrite on others; the store has to offer one of the two). Who comes second applies the change again
to the new version. Readers see whole versions; files of the versions kept by ``vacuum`` stay.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import vectorblocks
from docmill.operators.chunking import embedding_text
from docmill.operators.retrieval import postings
from docmill.session import shared_folder
from docmill.sources.documents import base_name, stem
from docmill.sources.indexjson import read_index_json, write_index_json

#: Segments of one tier that are joined to one of the next.
MOST_SEGMENTS = 4
#: Times that a change is applied again to a newer version before it gives up.
ATTEMPTS = 20
#: Paths of at most so many bytes are sent to every task, so that the rows they are joined with stay where they are.
SENT_BYTES = 16 << 20
#: Folders by value of the postings' identifiers.
BUCKETS = 16
_REGISTRY = "source_path string, content_hash string, chunk_count long, document_id string, title string, segment int"
_META = "embedding_model string, vector_dim int, created_at string, updated_at string, total_documents long, total_chunks long, segments array<int>"
_POSTING = "value string, source_path string, chunk_id string"
_COUNTS = ("added", "refreshed", "skipped", "removed")  # as a summary has them; a manifest also counts failed


class ModelMismatch(ValueError):
    """The index was built with another embedding model."""


class NoIndex(ValueError):
    """There is no index at the path."""


class ConcurrentChange(RuntimeError):
    """Another writer changed the index meanwhile; nothing of this change is visible."""


def actions(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_path, content_hash, action): added, refreshed or skipped. Registered paths that are not
    listed are untouched and not in the result."""
    old = registry.select("source_path", F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") == F.col("content_hash"), "skipped").otherwise("refreshed")
    return listing.join(old, "source_path", "left").select("source_path", "content_hash", action.alias("action"))


def merge(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The old rows without those of changed paths, and the new ones."""
    return old.join(changed.select("source_path"), "source_path", "left_anti").unionByName(new, allowMissingColumns=True)


def removal(registry: DataFrame, targets: DataFrame) -> DataFrame:
    """Registered paths that a target names: an exact path alone, else every path with the target's base
    name or that ends with the target. Both join by equality; of a path's suffixes only those take part
    that are as long as some target."""
    paths, named = registry.select("source_path").distinct(), targets.select("target").where("target is not null").distinct()
    exact = paths.join(named, paths["source_path"] == named["target"], "left_semi")
    loose = named.join(paths, named["target"] == paths["source_path"], "left_anti")
    names = loose.select(base_name(F.col("target")).alias("name")).distinct()
    same = paths.withColumn("name", base_name(F.col("source_path"))).join(names, "name", "left_semi").select("source_path")
    lengths = [r["n"] for r in loose.select(F.length("target").alias("n")).distinct().collect()]  # no more than the longest target's characters
    sizes = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("source_path"))
    ends = paths.withColumn("n", F.explode(sizes)).select("source_path", F.expr("right(source_path, n)").alias("target"))
    return exact.union(same).union(ends.join(loose, "target", "left_semi").select("source_path")).distinct()


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a file with its content in one step; False if it was there before."""
    at, fs = _at(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(at.getParent())
    draft, _ = _at(spark, f"{at.getParent().toString()}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(urlparse(p.toString()).path, spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            try:
                jvm.java.nio.file.Files.createLink(local(at), local(draft))
            except Exception as error:
                if "FileAlreadyExists" in str(error):
                    return False
                raise
            return True
        return fs.rename(draft, at)
    finally:
        fs.delete(draft, False)


def latest(spark: SparkSession, path: str) -> int:
    """The latest version, 0 without any."""
    return max((int(n) for n in _names(spark, f"{path}/log") if n.isdigit()), default=0)


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    rows = spark.read.text(f"{path}/log/{version:012d}", wholetext=True).collect()  # one small file
    return json.loads(rows[0][0])


def bucket(value: Column) -> Column:
    """The folder of an identifier's postings."""
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS))


class _Change:
    """A change being made: the version it starts from, and its segment."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.base = latest(spark, path)
        self.meta = _manifest(spark, path, self.base) if self.base else {}
        number = max([self.meta.get("last_segment", 0), *(int(n[1:]) for n in _names(spark, f"{path}/segments") if n[1:].isdigit())]) + 1
        while not create_once(spark, f"{path}/segments/s{number}/CLAIM", ""):  # two changes never share a segment
            number += 1
        self.number = number

    def write(self, rows: DataFrame, name: str, *by: str) -> DataFrame:
        """The rows, stored in this change's segment and read from there."""
        at = f"{self.path}/segments/s{self.number}/{name}"
        (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def vectors(self, rows: DataFrame) -> int | None:
        """Stores vectors (source_path, chunk_id, v) as blocks; their dimension, if there are any."""
        own = self.write(rows.select("source_path", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("v").cast("array<double>").alias("v")), "made")
        blocks = self.write(vectorblocks.build(own, lambda rows: self.write(rows, "placed")), "blocks")
        for name in ("made", "placed"):
            at, fs = _at(self.spark, f"{self.path}/segments/s{self.number}/{name}")
            fs.delete(at, True)
        return blocks.agg(F.max("dim")).first()[0]

    def index(self, chunks: DataFrame) -> None:
        """Stores the postings of chunks that have identifiers, in folders by their values."""
        if "codes" in chunks.columns:
            own = postings(chunks, "source_path").select("value", "source_path", F.col("chunk_id").cast("string").alias("chunk_id"), bucket(F.col("value")).alias("bucket"))
            self.write(own.repartition("bucket", F.xxhash64("source_path") % 8).sortWithinPartitions("bucket", "value"), "postings", "bucket")

    def finish(self, entries: DataFrame | None, model: str, vector_dim: int | None, now: str, segments: list[int], **more) -> int:
        """Makes this change the next version. ``entries`` are its registry rows, None if it has no segment."""
        if entries is not None:
            self.write(entries, "registry")
            segments = [s for s in segments if s != self.number] + [self.number]
        tiers = {k: v for k, v in {**self.meta.get("tiers", {}), **more.pop("tiers", {})}.items() if int(k) in segments}
        meta = {
            "embedding_model": model, "vector_dim": vector_dim, "created_at": self.meta.get("created_at") or now, "updated_at": now, "segments": segments, "tiers": tiers, "last_segment": self.number,
            "counts": more.pop("counts", {}), "actions": more.pop("actions", None),
        }
        totals = _registry(self.spark, self.path, segments).agg(F.count("*").alias("d"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("c")).first()
        meta |= {"total_documents": totals["d"], "total_chunks": totals["c"]}
        if not create_once(self.spark, f"{self.path}/log/{self.base + 1:012d}", json.dumps(meta)):
            raise ConcurrentChange(f"the index is no longer at version {self.base}")
        return self.base + 1


def _again(change: Callable[[], DataFrame | int | None]):
    """Applies a change, and applies it again to the new version if another one came before it."""
    for attempt in range(ATTEMPTS):
        try:
            return change()
        except ConcurrentChange:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(0.05 * attempt)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows; unlike those of createDataFrame they start no Python worker."""
    names = [c.strip().split(" ", 1) for c in schema.split(",")]
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in names))


def _union(frames: list[DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return empty() if out is None else out


def _entries(spark: SparkSession, path: str, segments: list[int]) -> DataFrame:
    """All registry rows with their place in the order of segments."""
    own = [spark.read.parquet(f"{path}/segments/s{s}/registry").withColumn("place", F.lit(k)) for k, s in enumerate(segments)]
    return _union(own, lambda: _none(spark, f"{_REGISTRY}, place int"))


def _registry(spark: SparkSession, path: str, segments: list[int]) -> DataFrame:
    """Each document's last registry row, unless that removed it."""
    names = [c.split(" ")[0] for c in _REGISTRY.split(", ")]
    last = _entries(spark, path, segments).groupBy("source_path").agg(F.max_by(F.struct(*names[1:]), "place").alias("e"))
    return last.select("source_path", "e.*").where("segment is not null")


def _dead(spark: SparkSession, path: str, segments: list[int]) -> DataFrame | None:
    """(segment, source_path) of rows in segments that a later segment has replaced or removed."""
    if len(segments) < 2:
        return None
    own = _entries(spark, path, segments).where("segment is not null").select("source_path", "segment")
    return _small(own.join(_registry(spark, path, segments).select("source_path", "segment"), ["source_path", "segment"], "left_anti").select("segment", "source_path"))


def _rows(spark: SparkSession, path: str, segments: list[int], name: str, empty: str) -> DataFrame:
    # chunks have whatever columns they were given; a table written by folders may have no file
    reader = spark.read if name == "chunks" else spark.read.schema(empty)
    own = [reader.parquet(f"{path}/segments/s{s}/{name}").withColumn("segment", F.lit(s)) for s in segments if _exists(spark, f"{path}/segments/s{s}/{name}")]
    return _union(own, lambda: _none(spark, f"{empty}, segment int"))


def _small(paths: DataFrame) -> DataFrame:
    """The rows, to be sent to every task if their paths have at most SENT_BYTES, else as they are."""
    size = paths.agg(F.coalesce(F.sum(F.length("source_path") * 4 + 32), F.lit(0))).first()[0]
    return F.broadcast(paths) if size <= SENT_BYTES else paths


def _alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return (rows if dead is None else rows.join(dead, ["segment", "source_path"], "left_anti")).drop("segment")


def load(spark: SparkSession, path: str, version: int = 0) -> dict[str, DataFrame] | None:
    """chunks, vectors, postings, registry and meta of a version (the latest without one), or None."""
    version = version or latest(spark, path)
    if not version:
        return None
    meta = _manifest(spark, path, version)
    segments = meta["segments"]
    dead = _dead(spark, path, segments)
    row = tuple(meta[c.split(" ")[0]] for c in _META.split(", "))
    return {
        "registry": _registry(spark, path, segments),
        "meta": spark.createDataFrame([row], _META),
        "chunks": _alive(_rows(spark, path, segments, "chunks", "source_path string, chunk_id string"), dead),
        "vectors": _alive(vectorblocks.unpack(_rows(spark, path, segments, "blocks", vectorblocks.BLOCK_SCHEMA)), dead),
        "postings": _alive(_rows(spark, path, segments, "postings", f"{_POSTING}, bucket long"), dead),
    }


def chunks_of(spark: SparkSession, path: str, keys: DataFrame, version: int = 0) -> DataFrame:
    """The chunks of a version that keys (source_path, chunk_id) name; few keys are sent to the chunks. They are picked before
    it is asked whether their documents are still there, so that no other text is shuffled for that."""
    version = version or latest(spark, path)
    if not version:
        raise NoIndex(path)
    segments = _manifest(spark, path, version)["segments"]
    rows = _rows(spark, path, segments, "chunks", "source_path string, chunk_id string")
    return _alive(rows.join(_small(keys), ["source_path", "chunk_id"], "left_semi"), _dead(spark, path, segments))


def search(spark: SparkSession, path: str, queries: DataFrame, config, version: int = 0) -> tuple[DataFrame, DataFrame]:
    """(hits, work) of ``vectorblocks.search`` over the vectors of a version of the index."""
    version = version or latest(spark, path)
    if not version:
        raise NoIndex(path)
    segments = _manifest(spark, path, version)["segments"]

    def keep(rows: DataFrame, what: str) -> DataFrame:
        at = shared_folder(spark, f"search-{what}")
        rows.write.parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    dead = _dead(spark, path, segments)
    return vectorblocks.search(_rows(spark, path, segments, "blocks", vectorblocks.BLOCK_SCHEMA), queries, config, keep, _small(keep(dead, "dead")) if dead is not None else None)


def embeddable(chunks: DataFrame) -> DataFrame:
    """Chunks with embedding_text, the text that is to be embedded: headed by the section where there is one."""
    section = F.col("section") if "section" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumn("embedding_text", embedding_text(section, F.col("text"))) if "text" in chunks.columns else chunks


def update(spark: SparkSession, path: str, files: DataFrame, parse: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], model: str = "", now: str = "") -> DataFrame:
    """Brings an index up to date with files (source_path, content binary, content_hash); returns the actions.

    ``parse`` turns changed files into chunks (with source_path and chunk_id; document_id and title if they
    are known, codes for postings), ``embed`` chunks into vectors (chunk_id, source_path, v); it is given
    embedding_text. Each changed file is parsed once, and each chunk embedded once, from what was stored. A path
    that is listed twice counts once. Where ``parse`` has a column error, a row that isn't null there says that its
    file has no chunks: such a file's action is ``failed``, ``failures`` has its error, what the index held of it stays,
    and it is tried again next time.
    """

    def change() -> DataFrame:
        own = _Change(spark, path)
        known = own.meta.get("embedding_model", "")
        if known and model and known != model:
            raise ModelMismatch(f"the index holds vectors of {known}, not {model}")
        segments = own.meta.get("segments", [])
        # whole files are only shuffled where a path is listed twice
        twice = files.groupBy("source_path").count().where("count > 1").limit(1).count()
        listed = files.dropDuplicates(["source_path"]) if twice else files
        todo = own.write(actions(listed.select("source_path", "content_hash"), _registry(spark, path, segments)), "wanted")
        counts = {r["action"]: r["count"] for r in todo.groupBy("action").count().collect()}
        more = {"counts": counts, "actions": own.number}
        dim = own.meta.get("vector_dim")
        if not counts.get("added") and not counts.get("refreshed"):
            done = own.write(todo, "actions")
            own.finish(None, model or known, dim, now, segments, **more)
            return done
        changed = listed.join(_small(todo.where("action <> 'skipped'").select("source_path")), "source_path", "left_semi") if counts.get("skipped") else listed
        parsed = parse(changed)
        if "error" in parsed.columns:
            parsed = own.write(parsed, "parsed")
            failed = own.write(parsed.where("error is not null").groupBy("source_path").agg(F.min("error").alias("error")), "failures")
            chunks = own.write(parsed.join(failed, "source_path", "left_anti").drop("error"), "chunks")
            todo = own.write(todo.join(failed.select("source_path", F.lit("failed").alias("fault")), "source_path", "left").withColumn("action", F.coalesce("fault", "action")).drop("fault"), "actions")
            more["counts"] = {r["action"]: r["count"] for r in todo.groupBy("action").count().collect()}
        else:
            chunks, todo = own.write(parsed, "chunks"), own.write(todo, "actions")
        own.index(chunks)
        dim = own.vectors(embed(embeddable(chunks))) or dim
        ids = [F.min(c).alias(f"own_{c}") for c in ("document_id", "title") if c in chunks.columns]
        made = chunks.groupBy("source_path").agg(F.count("*").alias("n"), *ids)
        name = F.coalesce(F.col("own_document_id") if "document_id" in chunks.columns else F.lit(None), stem(F.col("source_path")))
        title = F.coalesce(F.col("own_title") if "title" in chunks.columns else F.lit(None), name)
        entries = todo.where("action not in ('skipped', 'failed')").join(made, "source_path", "left").select(
            "source_path", "content_hash", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"), name.alias("document_id"), title.alias("title"), F.lit(own.number).alias("segment")
        )
        own.finish(entries, model or known, dim, now, segments, **more)
        return todo

    done = _again(change)
    join_tiers(spark, path)
    return done


def join_tiers(spark: SparkSession, path: str) -> None:
    """Joins MOST_SEGMENTS neighbours of one tier, as long as there are any. If another change comes first, that
    one's own turn will do it."""
    while version := latest(spark, path):
        meta = _manifest(spark, path, version)
        segments, tiers = meta["segments"], meta["tiers"]
        tier = [tiers.get(str(s), 0) for s in segments]
        runs = [k for k in range(len(segments) - MOST_SEGMENTS + 1) if len(set(tier[k : k + MOST_SEGMENTS])) == 1]
        if not runs:
            return
        try:
            _join(spark, path, segments[runs[-1] : runs[-1] + MOST_SEGMENTS], tier[runs[-1]] + 1)
        except ConcurrentChange:
            return


def _join(spark: SparkSession, path: str, some: list[int], tier: int) -> None:
    """Writes the live rows of neighbouring segments as one; all that the version says otherwise stays."""
    own = _Change(spark, path)
    segments = own.meta["segments"]
    if not set(some) <= set(segments):
        raise ConcurrentChange("the segments have been joined already")
    dead = _dead(spark, path, segments)
    chunks = _alive(_rows(spark, path, some, "chunks", "source_path string, chunk_id string"), dead)
    own.index(own.write(chunks, "chunks"))
    own.vectors(_alive(vectorblocks.unpack(_rows(spark, path, some, "blocks", vectorblocks.BLOCK_SCHEMA)), dead))
    # removals go once nothing older is left that they could hide
    last = _entries(spark, path, some).groupBy("source_path").agg(F.max_by(F.struct("content_hash", "chunk_count", "document_id", "title", "segment"), "place").alias("e")).select("source_path", "e.*")
    if some[0] == segments[0]:
        last = last.where("segment is not null")
    entries = own.write(last.withColumn("segment", F.when(F.col("segment").isNotNull(), own.number)), "registry")
    at = segments.index(some[0])
    meta = own.meta
    order = segments[:at] + [own.number] + segments[at + len(some) :]
    entries.count()
    _commit_order(own, order, {**meta["tiers"], str(own.number): tier})


def _commit_order(own: _Change, segments: list[int], tiers: dict[str, int]) -> None:
    meta = {**own.meta, "segments": segments, "tiers": {k: v for k, v in tiers.items() if int(k) in segments}, "last_segment": own.number}
    if not create_once(own.spark, f"{own.path}/log/{own.base + 1:012d}", json.dumps(meta)):
        raise ConcurrentChange(f"the index is no longer at version {own.base}")


def compact(spark: SparkSession, path: str) -> None:
    """Writes the live rows of all segments as one."""

    def change() -> None:
        version = latest(spark, path)
        if not version:
            raise NoIndex(path)
        meta = _manifest(spark, path, version)
        if len(meta["segments"]) > 1:
            _join(spark, path, meta["segments"], 1 + max((meta["tiers"].get(str(s), 0) for s in meta["segments"]), default=0))

    _again(change)


def remove(spark: SparkSession, path: str, targets: list[str], now: str = "") -> DataFrame:
    """Removes the documents that the targets name; returns their paths."""

    def change() -> DataFrame:
        if not latest(spark, path):
            raise NoIndex(path)
        own = _Change(spark, path)
        meta = own.meta
        registry = _registry(spark, path, meta["segments"])
        gone = removal(registry, spark.createDataFrame([(t,) for t in targets], "target string"))
        gone = own.write(registry.join(gone, "source_path", "left_semi").select("source_path", "content_hash", F.lit("removed").alias("action")), "actions")
        count = gone.count()
        empty = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in _REGISTRY.split(", ")[1:]}
        entries = gone.select("source_path", *(v.alias(k) for k, v in empty.items())) if count else None
        own.finish(entries, meta["embedding_model"], meta["vector_dim"], now, meta["segments"], counts={"removed": count}, actions=own.number)
        return gone.select("source_path")

    done = _again(change)
    join_tiers(spark, path)
    return done


def reembed(spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame], model: str, now: str = "") -> int:
    """Makes every vector anew from the stored chunks with another model; returns how many. The files need
    not be there; until all vectors are written readers see the old ones."""

    def change() -> int:
        old = load(spark, path)
        if old is None:
            raise NoIndex(path)
        own = _Change(spark, path)
        chunks = own.write(old["chunks"], "chunks")
        own.index(chunks)
        dim = own.vectors(embed(embeddable(chunks)))
        # the blocks are asked, so that nothing is embedded again
        made = spark.read.parquet(f"{path}/segments/s{own.number}/blocks").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        if made != chunks.count():
            raise ValueError(f"{made} vectors for {chunks.count()} chunks")
        own.finish(old["registry"].withColumn("segment", F.lit(own.number)), model, dim, now, [own.number], tiers={str(own.number): max(own.meta["tiers"].values(), default=0)})
        return made

    return _again(change)


def last_actions(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """(source_path, content_hash, action) of the latest change that looked at files or removed some."""
    version = version or latest(spark, path)
    number = _manifest(spark, path, version)["actions"] if version else None
    if number is None:
        return spark.createDataFrame([], "source_path string, content_hash string, action string")
    return spark.read.parquet(f"{path}/segments/s{number}/actions")


def failures(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """(source_path, error) of files that the latest change could not take."""
    version = version or latest(spark, path)
    number = _manifest(spark, path, version)["actions"] if version else None
    at = f"{path}/segments/s{number}/failures"
    return spark.read.parquet(at) if number is not None and _exists(spark, at) else spark.createDataFrame([], "source_path string, error string")


def summary(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """One row on the latest change: added, refreshed, skipped, removed, total_documents, total_chunks."""
    version = version or latest(spark, path)
    if not version:
        raise NoIndex(path)
    meta = _manifest(spark, path, version)
    row = [meta["counts"].get(c, 0) for c in _COUNTS] + [meta["total_documents"], meta["total_chunks"]]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{c} long" for c in (*_COUNTS, "total_documents", "total_chunks")))


def model_warning(spark: SparkSession, path: str, model: str) -> str | None:
    """What to say to one who asks with another model than the index was made with; None if the models agree or
    one of them isn't known."""
    version = latest(spark, path)
    known = _manifest(spark, path, version)["embedding_model"] if version else ""
    return f"the index was made with embedding model {known}, the question is embedded with {model}" if known and model and known != model else None


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 7 * 24 * 3600) -> list[str]:
    """Deletes log entries but the latest ``keep``, and segments that none of those names and that were begun more than
    ``older_than`` seconds ago (a change that is being made is in no entry yet). Returns the segments' names."""
    version = latest(spark, path)
    kept = [v for v in sorted(int(n) for n in _names(spark, f"{path}/log") if n.isdigit()) if v > version - max(1, keep)]
    named: set[int] = set()
    for v in kept:
        meta = _manifest(spark, path, v)
        named |= {*meta["segments"], *([meta["actions"]] if meta["actions"] is not None else [])}
    for n in _names(spark, f"{path}/log"):
        if n.isdigit() and int(n) not in kept:
            at, fs = _at(spark, f"{path}/log/{n}")
            fs.delete(at, False)
    gone = []
    for n in _names(spark, f"{path}/segments"):
        claim, fs = _at(spark, f"{path}/segments/{n}/CLAIM")
        old = not fs.exists(claim) or time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 >= older_than
        if int(n[1:]) not in named and old:
            fs.delete(claim.getParent(), True)
            gone.append(n)
    return sorted(gone)


def info(chunks: DataFrame) -> DataFrame:
    """(source_path, chunk_count) by path."""
    return chunks.groupBy("source_path").agg(F.count("*").alias("chunk_count"))


def export_json(spark: SparkSession, path: str, target: str, version: int = 0, one_file: bool = False) -> None:
    """Writes a version as one JSON document (``sources/indexjson``)."""
    index = load(spark, path, version)
    if index is None:
        raise NoIndex(path)
    write_index_json(spark, index, target, one_file)


def import_json(spark: SparkSession, source: str, path: str, now: str = "") -> int:
    """Makes an index's next version from a JSON document, in place of what it held; returns the version.

    A vector belongs to the chunk of its id; a chunk without a vector is kept, and found by its identifiers alone.
    Chunks of a path that the document's registry lacks get a registry row without a hash, so the next update
    reads that file again. Times are the document's; ``now`` counts where it has none.
    """
    given = read_index_json(spark, source)
    said = given["meta"].first()

    def change() -> int:
        own = _Change(spark, path)
        chunks = own.write(given["chunks"], "chunks")
        own.index(chunks)
        dim = own.vectors(given["vectors"].join(chunks.select("chunk_id", "source_path"), "chunk_id"))
        held = chunks.groupBy("source_path").agg(F.count("*").alias("n"), F.min("document_id").alias("own_id"))
        # of several rows of one path the one with the greatest hash counts
        known = given["registry"].groupBy("source_path").agg(F.max(F.struct("content_hash", "document_id", "title")).alias("d")).select("source_path", "d.*")
        entries = held.join(known, "source_path", "full").select(
            "source_path", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"),
            F.coalesce("document_id", "own_id").alias("document_id"), F.coalesce("title", "document_id", "own_id").alias("title"), F.lit(own.number).alias("segment"),
        )
        own.meta = {"last_segment": own.meta.get("last_segment", 0), "created_at": said["created_at"] or now}
        return own.finish(entries, said["embedding_model"], dim or said["vector_dim"], said["updated_at"] or now, [])

    return _again(change)

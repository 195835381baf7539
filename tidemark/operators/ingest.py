"""Incremental maintenance: snapshot diffs, keyed merges, pruning, cursors, the file pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalar
from tidemark.functions.text import to_tsvector
from tidemark.functions.vector import stub_embedding
from tidemark.operators import chunk, scrub

REPLACED = ("content", "content_hash", "embedding", "tsv", "context_breadcrumb", "metadata", "parse_status", "secrets_status", "updated_at")
GITLINK = "160000"


def without_gitlinks(entries: DataFrame) -> DataFrame:
    """Tree or diff entries that aren't submodules on either side."""
    for mode in ("mode", "old_mode", "new_mode"):
        if mode in entries.columns:
            entries = entries.filter(F.coalesce(F.col(mode), F.lit("")) != GITLINK)
    return entries


def changed_entries(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(path, status) between two snapshots (path, content_hash, perhaps mode). Without an old one
    everything is added; else what is new or differs is modified, and what is gone is deleted (a
    rename is both). Submodules, told by their mode, are no entries on either side."""
    new = without_gitlinks(new)
    old = None if old is None else without_gitlinks(old)
    if old is None:
        return new.select("path", F.lit("added").alias("status"))
    o, n = old.select("path", F.col("content_hash").alias("o")), new.select("path", F.col("content_hash").alias("n"))
    both = o.withColumn("in_o", F.lit(True)).join(n.withColumn("in_n", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("in_n").isNull(), "deleted").when(F.col("in_o").isNull() | ~F.col("o").eqNullSafe(F.col("n")), "modified")
    return both.select("path", status.alias("status")).filter("status is not null")


def merge(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str] | tuple[str, ...]) -> DataFrame:
    """old upserted with new on `keys`: where both have a row, columns in `replaced` come from new
    (nulls too) and all others stay; rows of either side alone stay as they are. One shuffle on the
    keys. new must hold each key once: a repeated one fails the query (see latest)."""
    o = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("o"))
    n = new.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("n"))
    # the count uses the partitioning that the join needs anyway
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    repeated = F.raise_error(F.concat(F.lit("merge: a key occurs twice: "), F.to_json(F.struct(*keys))))
    n = n.withColumn("_p", place).withColumn("n", F.when(F.col("_p") > 1, repeated.cast(n.schema["n"].dataType)).otherwise(F.col("n"))).drop("_p")
    both = o.join(n, keys, "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        first, second = ("n", "o") if c in replaced else ("o", "n")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c)

    return both.select(*(pick(c) for c in old.columns))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, so that a merge sees each key once."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after an upsert on (source_id, chunk_key)."""
    return merge(old, model.check_domains(new), ["source_id", "chunk_key"], REPLACED)


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """The source registry after an upsert: only name and updated_at of a known source change."""
    return merge(old, model.check_domains(new), ["source_type", "identifier"], ("name", "updated_at"))


def prune(chunks: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """chunks without those whose (source_id, metadata[key]) is in gone(source_id, <key>)."""
    dead = gone.select(F.col("source_id").alias("_s"), F.col(key).alias("_k")).distinct()
    return chunks.join(dead, (chunks["source_id"] == dead["_s"]) & (chunks["metadata"][key] == dead["_k"]), "left_anti")


def prune_stale(chunks: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """chunks without those of files that were chunked anew, but whose chunk_key isn't among the
    new ones (a file that shrank leaves such chunks behind)."""
    files = fresh.select(F.col("source_id").alias("_s"), F.col("metadata")[key].alias("_k")).distinct()
    known = fresh.select("source_id", "chunk_key").distinct()
    touched = chunks.join(files, (chunks["source_id"] == files["_s"]) & (chunks["metadata"][key] == files["_k"]), "left_semi")
    stale = touched.join(known, ["source_id", "chunk_key"], "left_anti").select("source_id", "chunk_key")
    return chunks.join(stale, ["source_id", "chunk_key"], "left_anti")


def cascade(sources: DataFrame, chunks: DataFrame, states: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the sources in deleted(id) are gone, with all that refers to them."""
    ids = deleted.select(F.col("id").alias("source_id")).distinct()
    return sources.join(deleted.select("id"), "id", "left_anti"), chunks.join(ids, "source_id", "left_anti"), states.join(ids, "source_id", "left_anti")


def advance_cursors(states: DataFrame, moved: DataFrame) -> DataFrame:
    """sync_states after moved(source_id, key, value, at): cursor[key] = value, status idle; a null
    value changes nothing; a source without a state gets one. A source may move several keys; of
    several values for one key the last by `at` counts (then the greatest)."""
    some = moved.filter("value is not null").groupBy("source_id", "key").agg(F.max(F.struct("at", "value")).alias("last"))
    m = some.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "last.value"))).alias("moved"), F.max("last.at").alias("moved_at"))
    both = states.join(m, "source_id", "full_outer")
    kept = F.map_filter(F.coalesce("cursor", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.col("moved"), k))
    hit = F.col("moved").isNotNull()
    cursor = F.when(hit, F.map_concat(kept, "moved")).otherwise(F.col("cursor"))
    return both.select("source_id", cursor.alias("cursor"), F.when(hit, "idle").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("moved_at")).otherwise(F.col("last_synced_at")).alias("last_synced_at"))


def watermark(rows: DataFrame, column: str) -> DataFrame:
    """The greatest value of a string column by string order, nulls aside; null without rows."""
    return rows.agg(F.max(column).alias("watermark"))


def head(commits: DataFrame) -> DataFrame:
    """(repo, sha) of the newest commit of each repository; empty repositories give no row."""
    return commits.groupBy("repo").agg(F.max_by("sha", F.struct("committed_at", "sha")).alias("sha"))


def moved_heads(heads: DataFrame, states: DataFrame) -> DataFrame:
    """Heads (source_id, sha) that differ from the cursor's last_sha: the sources with work to do."""
    last = states.select("source_id", F.col("cursor")["last_sha"].alias("last_sha"))
    return heads.join(last, "source_id", "left").filter(~F.col("sha").eqNullSafe(F.col("last_sha")))


def raw_rows(files: DataFrame) -> DataFrame:
    """Raw rows of files(source_id, repo, ref, path, content): text only, keyed and hashed."""
    text = files.filter(F.col("content").isNotNull() & ~scalar.is_binary(F.col("content").cast("binary")) & (F.octet_length("content") <= scalar.MAX_FILE_BYTES))
    return text.select(
        "source_id", F.lit("git_repo").alias("source_type"), "repo", scalar.language(F.col("path")).alias("lang"), scalar.natural_key("repo", F.col("source_id"), F.col("path")).alias("natural_key"),
        F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("raw_content"), F.create_map(F.lit("path"), F.col("path"), F.lit("ref"), F.col("ref")).alias("metadata"),
    )


def insert_raw(rows: list[dict], spark: SparkSession) -> DataFrame:
    """Raw rows out of dicts, checked one by one: required columns there, domains kept. ValueError
    names the first that is wrong; binary content is left out."""
    for i, row in enumerate(rows):
        missing = [f.name for f in model.RAW_FILES if not f.nullable and row.get(f.name) is None]
        unknown = sorted(set(row) - set(model.RAW_FILES.fieldNames()))
        if missing or unknown:
            raise ValueError(f"row {i}: " + ", ".join([*(f"{c} is missing" for c in missing), *(f"{c} is unknown" for c in unknown)]))
        if row["source_type"] not in model.SOURCE_TYPES:
            raise ValueError(f"row {i}: source_type is outside its domain: {row['source_type']}")
    df = spark.createDataFrame([tuple(row.get(c) for c in model.RAW_FILES.fieldNames()) for row in rows], model.RAW_FILES)
    return df.filter(~F.coalesce(scalar.is_binary(F.col("raw_content").cast("binary")), F.lit(False)))


def chunk_table(raw: DataFrame, now: Column, embed: Callable[[Column], Column] | None = None, known: DataFrame | None = None, scrubbed: bool = False) -> DataFrame:
    """Rows of the chunk table out of raw rows: scrub (unless they come scrubbed), chunk, embed, and
    store the search vector. With `known` (chunk table), a chunk whose key and hash it has keeps
    that embedding instead of being embedded again."""
    rows = chunk.chunk_rows(raw if scrubbed else scrub.scrub_rows(raw))
    embed = embed or (lambda text: stub_embedding(text, model.DIMENSIONS))
    text = scalar.with_breadcrumb(F.col("context_breadcrumb"), F.col("content"))
    if known is None:
        vectors = rows.withColumn("embedding", embed(text).cast("array<float>"))
    else:
        have = known.select("source_id", "chunk_key", "content_hash", F.col("embedding").alias("have"))
        joined = rows.join(have, ["source_id", "chunk_key", "content_hash"], "left")
        kept, todo = joined.filter("have is not null").withColumnRenamed("have", "embedding"), joined.filter("have is null").drop("have")
        vectors = kept.unionByName(todo.withColumn("embedding", embed(text).cast("array<float>")))
    vectors = vectors.withColumn("tsv", to_tsvector(F.col("context_breadcrumb"), F.col("content")))
    identity = F.sha2(F.concat_ws("|", "source_id", "chunk_key"), 256)
    uuid = F.concat_ws("-", *(F.substring(identity, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return vectors.withColumn("id", uuid).withColumn("inserted_at", now).withColumn("updated_at", now).select(*model.CHUNKS.fieldNames())

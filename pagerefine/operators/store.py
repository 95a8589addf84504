"""The reference store as a table of whole texts: save, list, find, promote, delete, links.

State is a DataFrame of status, filepath, value; every operator returns a new one, and write_state() swaps versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerefine.functions import frontmatter, links
from pagerefine.functions.text import base_name, join_path, slug

STATE = "status string, filepath string, value string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _decoded(state: DataFrame) -> DataFrame:
    """References of the temporary files, with filepath and value; files without a header are left out."""
    files = state.where("status = 'temporary'").withColumn("file_name", base_name(F.col("filepath"))).where("file_name like '%.md'")
    return frontmatter.decode(files, keep=("filepath",))


def list_references(state: DataFrame) -> DataFrame:
    """Cached references, newest day first, ties by ref_id; promoted files and files without a header are left out."""
    found = _decoded(state).select("ref_id", "title", "url", "filepath", "fetched_date", "size", "query")
    return found.orderBy(F.desc("fetched_date"), "ref_id")


def find_by_url(state: DataFrame, urls: DataFrame) -> DataFrame:
    """For each url of urls(url), its first reference in list order, or nulls: url, ref_id, filepath. Exact equality."""
    by_day = _decoded(state).groupBy("url", "fetched_date").agg(F.min(F.struct("ref_id", "filepath")).alias("f"))
    first = by_day.groupBy("url").agg(F.max_by("f", "fetched_date").alias("f")).select("url", "f.ref_id", "f.filepath")
    return urls.select("url").join(first, "url", "left")


def find_by_ref(state: DataFrame, ref_ids: DataFrame) -> DataFrame:
    """For each id of ref_ids(ref_id), its reference, the first by path, or nulls: ref_id, filepath, url."""
    first = _decoded(state).groupBy("ref_id").agg(F.min(F.struct("filepath", "url")).alias("f")).select("ref_id", "f.filepath", "f.url")
    return ref_ids.select("ref_id").join(first, "ref_id", "left")


def save(state: DataFrame, batch: DataFrame, day: Column, temp_dir: str = ".tmp") -> tuple[DataFrame, DataFrame]:
    """Save batch(seq, title, url, content, query, refetch): the result of each row, and the new state.

    Results: seq, url, ref_id, filepath, already_exists, error. A url that is stored, or that came earlier in the
    batch, already exists unless it is refetched; then its path stays and its text is replaced. Of rows that end at
    one path the last by seq is kept, also if their urls differ. A null title is an error. What comes first or last is
    found by aggregates, which are combined before their shuffles, so that one url or title may have very many rows.
    """
    known = find_by_url(state, batch.select("url").distinct()).select("url", F.col("ref_id").alias("__ref"), F.col("filepath").alias("__path"))
    own = join_path(F.lit(temp_dir), F.concat(slug(F.col("title")), F.lit(".md")))
    good = batch.withColumn("__own", own).withColumn("__slug", slug(F.col("title"))).join(known, "url", "left")
    titled = good.where("title is not null").groupBy("url").agg(F.min(F.struct("seq", "__slug", "__own")).alias("__first"))
    rows = good.join(titled, "url", "left").withColumn("__first", F.when(F.col("__first.seq") < F.col("seq"), F.col("__first")))
    path, ref = F.coalesce("__path", "__first.__own"), F.coalesce("__ref", "__first.__slug")
    hit = path.isNotNull() & ~F.coalesce("refetch", F.lit(False))
    failed = F.col("title").isNull() & ~hit
    rows = rows.select(
        "seq", "url", "title", "content", "query", F.when(failed, F.lit("")).when(hit, ref).otherwise(F.col("__slug")).alias("ref_id"),
        F.when(failed, F.lit("")).otherwise(F.coalesce(path, "__own")).alias("filepath"), hit.alias("already_exists"), F.when(failed, F.lit("title is missing")).alias("error"),
    )
    results = rows.select("seq", "url", "ref_id", "filepath", "already_exists", "error")
    written = rows.where("not already_exists and error is null").groupBy("filepath")
    written = written.agg(F.max(F.struct("seq", "title", "url", "query", "content")).alias("w")).select("filepath", "w.*")
    text = frontmatter.encode(F.col("title"), F.col("url"), day, F.col("query"), F.col("content"))
    fresh = written.select(F.lit("temporary").alias("status"), "filepath", text.alias("value"))
    return results, state.join(fresh.select("filepath"), "filepath", "left_anti").select("status", "filepath", "value").unionByName(fresh)


def promote(state: DataFrame, ref_ids: DataFrame, temp_dir: str = ".tmp", docs_dir: str = "docs/ai/references") -> tuple[DataFrame, DataFrame]:
    """Move references to docs_dir: ref_id, success, from_path, to_path, error; and the new state.

    A promoted file takes the place of one of the same name there.
    """
    found = find_by_ref(state, ref_ids.distinct())
    to = join_path(F.lit(docs_dir), base_name(F.col("filepath")))
    ok = F.col("filepath").isNotNull()
    results = found.select(
        "ref_id", ok.alias("success"), F.coalesce("filepath", F.lit("")).alias("from_path"), F.coalesce(F.when(ok, to), F.lit("")).alias("to_path"),
        F.when(~ok, F.concat(F.lit("Reference "), "ref_id", F.lit(f" not found in {temp_dir}"))).alias("error"),
    )
    moved = state.join(results.where("success").select(F.col("from_path").alias("filepath"), "to_path"), "filepath")
    moved = moved.select(F.lit("permanent").alias("status"), F.col("to_path").alias("filepath"), frontmatter.permanent(F.col("value")).alias("value"))
    gone = results.where("success").select(F.explode(F.array("from_path", "to_path")).alias("filepath"))
    return results, state.join(gone, "filepath", "left_anti").select("status", "filepath", "value").unionByName(moved)


def delete(state: DataFrame, ref_ids: DataFrame, temp_dir: str = ".tmp") -> tuple[DataFrame, DataFrame]:
    """Delete references: ref_id, success, filepath, error; and the new state."""
    found = find_by_ref(state, ref_ids.distinct())
    ok = F.col("filepath").isNotNull()
    error = F.when(~ok, F.concat(F.lit("Reference "), "ref_id", F.lit(f" not found in {temp_dir}")))
    results = found.select("ref_id", ok.alias("success"), F.coalesce("filepath", F.lit("")).alias("filepath"), error.alias("error"))
    return results, state.join(results.where("success").select("filepath"), "filepath", "left_anti").select("status", "filepath", "value")


def reference_links(state: DataFrame, ref_ids: DataFrame, temp_dir: str = ".tmp") -> tuple[DataFrame, DataFrame]:
    """Links of references: source_ref, count, error; and source_ref, pos, text, href."""
    texts = _decoded(state).groupBy("ref_id").agg(F.min_by("value", "filepath").alias("value"))
    texts = texts.select("ref_id", frontmatter.strip(F.col("value")).alias("body"))
    rows = ref_ids.distinct().join(texts, "ref_id", "left")
    found = rows.select(F.col("ref_id").alias("source_ref"), "body", F.coalesce(F.size(links.web_links(F.col("body"))), F.lit(0)).cast("long").alias("count"))
    error = F.when(F.col("body").isNull(), F.concat(F.lit("Reference "), "source_ref", F.lit(f" not found in {temp_dir}")))
    return found.select("source_ref", F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.col("count")).alias("count"), error.alias("error")), links.exploded(rows.where("body is not null"), "ref_id", "body")


def write_state(state: DataFrame, folder: str) -> str:
    """Write a version of the store below folder, partitioned by status, and return its path.

    Versions are never overwritten, so a state may be read from one version while the next is written; a version
    counts once Spark has committed it (its _SUCCESS file).
    """
    import time
    import uuid

    path = f"{folder.rstrip('/')}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    state.write.partitionBy("status").parquet(path)
    return path


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A version of the store; a missing one is empty, a damaged one an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return empty(spark)
    return spark.read.parquet(path).select(F.col("status").cast("string").alias("status"), "filepath", "value")

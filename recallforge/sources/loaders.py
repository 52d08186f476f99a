"""Files into memories.  Listing and reading are Spark's, so any store it reads works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallforge.sources import chunkers

#: Extension to format.
FORMS = {"md": "markdown", "markdown": "markdown", "rst": "markdown", "txt": "plain", "text": "plain", "json": "json", "csv": "csv", "html": "html", "htm": "html"}


def _memories(files: DataFrame, most: int, domains: list[str] | None, agent: str, project: str | None, importance: float, subjects: list[str] | None) -> DataFrame:
    """path, text to memory rows: a stable id from path and position.  Without given
    domains the file's name is its domain."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for form in sorted(set(FORMS.values())):
        mine = files.where(ext.isin([e for e, f in FORMS.items() if f == form]))
        part = chunkers.chunk(mine, "text", form, most)
        out = part if out is None else out.unionByName(part)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    texts = lambda values: F.array(*map(F.lit, values or [])).cast("array<string>")
    return out.where(F.trim("chunk") != "").select(
        F.sha2(F.concat_ws("#", "path", F.col("position").cast("string")), 256).alias("memory_id"), F.col("chunk").alias("content"), F.sha2("chunk", 256).alias("content_hash"),
        F.array(F.lit("knowledge-loader"), F.concat(F.lit("source:"), name)).alias("tags"), "path", "position", F.lit("fact").alias("type"),
        (texts(domains) if domains else F.array(F.regexp_replace(name, r"\.[^.]*$", ""))).alias("domains"), F.lit(agent).alias("source_agent"), F.lit(project).cast("string").alias("project"),
        F.lit(float(importance)).alias("importance"), texts(subjects).alias("subjects"),
    )


def load(
    spark: SparkSession, path: str, *, recursive: bool = True, most: int = chunkers.MOST, domains: list[str] | None = None,
    agent: str = "knowledge-loader", project: str | None = None, importance: float = 6.0, subjects: list[str] | None = None,
) -> DataFrame:
    """A file or directory of supported texts as memories."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(FORMS) + "}")
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _memories(files, most, domains, agent, project, importance, subjects)


def load_documents(spark: SparkSession, path: str, convert, *, pattern: str = "*.{docx,pptx,pdf,xlsx}", **options) -> DataFrame:
    """Rich documents as memories: ``convert`` is a pandas UDF from bytes to Markdown,
    plugged in by the caller; what it cannot read (null) goes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    files = raw.select(F.concat("path", F.lit(".md")).alias("path"), convert(F.col("content")).alias("text")).where("text is not null")
    defaults = {"most": chunkers.MOST, "domains": None, "agent": "knowledge-loader", "project": None, "importance": 6.0, "subjects": None}
    return _memories(files, **(defaults | options))


def load_stats(memories: DataFrame) -> DataFrame:
    """One row: files, chunks and characters of a load, its progress in figures."""
    return memories.agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"))


def load_text(spark: SparkSession, text: str, name: str = "inline.txt", most: int = chunkers.MOST, *, domains: list[str] | None = None, importance: float = 6.0, project: str | None = None) -> DataFrame:
    rows = spark.createDataFrame([(name, text)], "path string, text string")
    return _memories(rows, most, domains, "knowledge-loader", project, importance, None)


def watch(spark: SparkSession, path: str, *, exclude: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A stream of new files: path, text, sha; each (path, content) once."""
    s = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    s = s.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("sha", F.sha2("text", 256))
    if exclude:
        s = s.where(~F.col("path").rlike(exclude))
    return s.dropDuplicates(["path", "sha"])


def write_memories(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append-only Parquet; readers take the last row of an id."""
    df.write.mode(mode).parquet(path)

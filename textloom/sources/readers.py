"""Sources: shards with positions, JSON lines, padded CSV, word lists, logs, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.select import running_before

MESSAGES = "array<struct<role:string,content:string>>"


def shards(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """text (and columns to `keep`) of all .parquet files with `file` (name) and `row`
    (position in the file)."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select("text", *keep, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def split_shards(rows: DataFrame, split: str) -> DataFrame:
    """The last file by name is the validation split, all others are training."""
    last = rows.agg(F.max("file").alias("last"))
    joined = rows.crossJoin(F.broadcast(last))  # one row
    return joined.where((F.col("file") == F.col("last")) == F.lit(split == "val")).drop("last")


def stripe_groups(rows: DataFrame, rank: int, world: int, group_rows: int = 1024) -> DataFrame:
    """Row groups rank, rank + world, ... of each file."""
    return rows.withColumn("group", F.floor(F.col("row") / group_rows)).where(F.pmod("group", F.lit(world)) == rank)


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """`n` passes over the rows with their epoch; order key (epoch, file, row)."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def resume(rows: DataFrame, file: str, group: int, epoch: int = 1) -> DataFrame:
    """Positions after (epoch, file, group)."""
    at = F.struct(F.col("epoch"), F.col("file"), F.col("group"))
    return rows.where(at > F.struct(F.lit(epoch), F.lit(file), F.lit(group).cast("long")))


def json_conversations(spark: SparkSession, path: str) -> DataFrame:
    """idx (from 0 without gaps), messages of a file with one JSON array a line; blank lines are skipped; a
    missing file is an empty relation."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"idx long, messages {MESSAGES}")
    lines = spark.read.text(path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    numbered = running_before(lines.withColumn("__line", F.monotonically_increasing_id()), F.lit(1), "__line", "idx")
    return numbered.select("idx", F.from_json("value", MESSAGES).alias("messages"))


def json_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def header_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema the types are inferred (a pass over the files)."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def padded_csv(lines: DataFrame, line: str = "line") -> DataFrame:
    """task, accuracy, centered of padded lines; the header, short and unreadable lines go."""
    p = F.transform(F.split(line, ","), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    rows = lines.select(p.alias("p")).where((F.size("p") >= 3) & (F.get("p", F.lit(0)) != "Task"))
    a, c = F.get("p", F.lit(1)), F.get("p", F.lit(2))
    ok = ((a == "") | a.try_cast("double").isNotNull()) & ((c == "") | c.try_cast("double").isNotNull())
    return rows.where(ok).select(F.get("p", F.lit(0)).alias("task"), F.nullif(a, F.lit("")).try_cast("double").alias("accuracy"), F.nullif(c, F.lit("")).try_cast("double").alias("centered"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.btrim("value", F.lit(" \t\r\n")).alias("word"))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """r, word: distinct letter words in sorted order with a dense rank from 0."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return running_before(words, F.lit(1), "word", "r", block=F.substring("word", 1, 2)).select("r", "word")


def yaml_tasks(spark: SparkSession, text: str) -> DataFrame:
    """label, icl_task_type, dataset_uri, num_fewshot, continuation_delimiter of a list of
    tasks in the plain subset of YAML that such files use; the delimiter defaults to a space."""
    items: list[dict[str, str]] = []
    lists: dict[str, list[int]] | None = None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if body.startswith("- ") and ":" in body:
            items.append({})
            lists = None
            body = body[2:].strip()
        if body.startswith("- ") and lists is not None:
            lists["num_fewshot"].append(int(body[2:]))
            continue
        key, _, value = body.partition(":")
        value = value.strip()
        if not items:
            continue
        if key == "num_fewshot":
            items[-1][key] = [int(x) for x in value.strip("[]").split(",") if x.strip()]
            lists = items[-1]
        else:
            items[-1][key] = value[1:-1].encode().decode("unicode_escape") if value[:1] in "'\"" and value else value
    rows = [(i.get("label"), i.get("icl_task_type"), i.get("dataset_uri"), i.get("num_fewshot", []), i.get("continuation_delimiter", " ")) for i in items]
    return spark.createDataFrame(rows, "label string, icl_task_type string, dataset_uri string, num_fewshot array<int>, continuation_delimiter string")


def wanted_shards(spark: SparkSession, n: int, last: int, present: DataFrame | None = None) -> DataFrame:
    """Indices to fetch: the first n and the validation shard, without those present."""
    ids = spark.range(n).unionByName(spark.range(last, last + 1)).distinct()
    return ids.join(present, "id", "left_anti") if present is not None else ids


def latest_checkpoint(listing: DataFrame) -> DataFrame:
    """tag, step: the deepest `d<N>` tag, else the newest; the last step by file name."""
    depth = F.nullif(F.regexp_extract("tag", r"^d(\d+)", 1), F.lit("")).cast("int")
    tags = listing.groupBy("tag").agg(F.max("mtime").alias("mtime")).withColumn("depth", depth)
    best = tags.agg(F.coalesce(F.max_by("tag", "depth"), F.max_by("tag", "mtime")).alias("tag"))
    name = F.regexp_extract("file", r"_([^_.]*)\.", 1)
    return listing.join(F.broadcast(best), "tag").groupBy("tag").agg(F.max(name).cast("long").alias("step"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """run (file name), line_no, line of log files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("run"), "value")
    return rows.select("run", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def environment(spark: SparkSession) -> DataFrame:
    """key, value: what a report header says about the run's surroundings."""
    import platform

    conf = spark.sparkContext.getConf()
    facts = {"spark": spark.version, "master": conf.get("spark.master", ""), "parallelism": str(spark.sparkContext.defaultParallelism), "shuffle partitions": spark.conf.get("spark.sql.shuffle.partitions"), "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "python": platform.python_version(), "machine": platform.machine()}
    return spark.createDataFrame(list(facts.items()), "key string, value string")

"""Where the lines of new files come from: spans of each file, and the file and line that had them first.

    python -m jobs.line_origins DOCUMENTS OUTPUT [--config jobs/line_origins.json]

DOCUMENTS is a folder of Parquet files (doc_id long, text string, source string) to which files are added, or a
pattern of such; a source stands for a repository, a document for a file in it. The job is a file stream that takes what is new
and ends (availableNow). It keeps, in OUTPUT,

    checkpoint/                 which files have been taken
    origins/batch=B/bucket=K/   (source, h1, h2, doc_id, line_no): the first place of each line, never rewritten
    spans/batch=B/bucket=K/     (doc_id, source, final_start_line, line_count, origin_doc, origin_start_line)

A line's origin is the place it had in the batch that brought it first, and there the smallest (doc_id,
line_no) of its source. So files that arrive later point back, also into themselves, and what was written
before stays as it is. Lines of fewer than ``min_chars`` characters, trimmed, say nothing about where they
come from and are their own origin. Consecutive lines with consecutive origins are one span.

A batch whose write was broken off is taken again with the same input (the checkpoint fixes it), reads only
origins of batches before it, and overwrites its own partitions; so the result of a rerun is the same, and a
run without new files writes nothing. A batch reads the origins of its own sources' buckets only. A null source
is the empty one; rows without doc_id or text have no lines; doc_id is the key of a file, so a table that repeats
it is an error upstream, and each of its rows gets spans as if the lines were laid over each other.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from strata.operators import blame
from strata.storage import shared_dir

log = logging.getLogger("jobs.line_origins")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "line_origins.json")
DOCUMENTS = "doc_id long, text string, source string"
ORIGINS = "source string, h1 long, h2 long, doc_id long, line_no long, batch long, bucket int"
SPANS = "doc_id long, source string, final_start_line long, line_count long, origin_doc long, origin_start_line long, batch long, bucket int"
LINE = ["source", "h1", "h2"]


def load(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def lines_of(documents: DataFrame, config: dict) -> DataFrame:
    """(doc_id, bucket, source, line_no, h1, h2, counts): a row for each line; ``counts`` if it is long enough."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bucket = F.pmod(F.crc32("source"), F.lit(config["buckets"])).cast("int")
    return rows.select("doc_id", bucket.alias("bucket"), "source", (F.col("pos") + 1).cast("long").alias("line_no"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), (F.length(F.trim("line")) >= config["min_chars"]).alias("counts"))


def attribute(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places of lines that are new, spans). ``known``: (source, h1, h2, doc_id, line_no) of lines seen before."""
    first = lines.where("counts").groupBy("bucket", *LINE).agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    seen = known.select(*LINE, F.struct("doc_id", "line_no").alias("seen"))
    place = first.join(seen, LINE, "left")
    new = place.where("seen is null").select("bucket", *LINE, "first.*")
    origin = place.select(*LINE, F.coalesce("seen", "first").alias("origin"))
    # a line of many files is one key of this join: its large side is split by adaptive execution
    found = lines.where("counts").join(origin, LINE).select("doc_id", "bucket", "source", "line_no", F.col("origin.doc_id").alias("origin_doc"), F.col("origin.line_no").alias("origin_line"))
    own = lines.where("not counts").select("doc_id", "bucket", "source", "line_no", F.col("doc_id").alias("origin_doc"), F.col("line_no").alias("origin_line"))
    spans = blame.spans(found.unionByName(own), ["doc_id", "bucket"], final="line_no", commit="origin_doc", origin="origin_line", path="source")
    return new, spans.select("doc_id", "bucket", "source", "final_start_line", "line_count", "origin_doc", F.col("origin_start_line"))


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> None:
    """Take the files of ``documents`` that are new since the last run into ``output``; returns when all are done."""
    config = load() | (config or {})
    output = output.rstrip("/")
    for name, schema in (("origins", ORIGINS), ("spans", SPANS)):  # so that they can be read before the first batch
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch", "bucket").parquet(f"{output}/{name}")

    def put(df: DataFrame, name: str, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{output}/{name}")

    def take(docs: DataFrame, batch: int) -> None:
        session = docs.sparkSession
        lines = lines_of(docs, config).persist(StorageLevel.DISK_ONLY)
        try:
            seen = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("files"), F.collect_set("bucket").alias("buckets")).first()
            known = session.read.schema(ORIGINS).parquet(f"{output}/origins").where((F.col("batch") < batch) & F.col("bucket").isin(seen["buckets"]))
            new, spans = attribute(lines, known)
            put(new, "origins", batch)
            put(spans, "spans", batch)
        finally:
            lines.unpersist()
        written = {name: session.read.schema(schema).parquet(f"{output}/{name}").where(F.col("batch") == batch).count() for name, schema in (("origins", ORIGINS), ("spans", SPANS))}
        log.info("batch %d: read %d lines of %d files; wrote %d first places and %d spans", batch, seen["lines"], seen["files"], written["origins"], written["spans"])

    stream = spark.readStream.schema(DOCUMENTS)
    if config["max_files_per_trigger"]:
        stream = stream.option("maxFilesPerTrigger", config["max_files_per_trigger"])
    log.info("reading %s", documents)
    query = stream.parquet(documents).writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("wrote %s", output)


def read(spark: SparkSession, output: str) -> DataFrame:
    """The spans as they stand."""
    return spark.read.schema(SPANS).parquet(f"{output}/spans").drop("batch", "bucket")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table; the second finds nothing new."""
    output = f"{shared_dir(spark)}/job1_line_origins-{uuid.uuid4().hex}"
    for _ in range(2):  # a table can be one file, which is no folder: a pattern stands for both
        run(spark, f"{sf_dir}/documents.parque[t]", output)
    return read(spark, output)


SQL = """
with l as (select doc_id, coalesce(source, '') as source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where doc_id is not null and text is not null),
o as (select source, line, doc_id as origin_doc, line_no as origin_line from l where length(trim(line)) >= 12 qualify row_number() over (partition by source, line order by doc_id, line_no) = 1),
a as (select l.doc_id, l.source, l.line_no, coalesce(o.origin_doc, l.doc_id) as origin_doc, coalesce(o.origin_line, l.line_no) as origin_line from l left join o on o.source = l.source and o.line = l.line),
g as (select *, line_no - row_number() over (partition by doc_id, origin_doc, line_no - origin_line order by line_no) as k from a)
select doc_id, source, cast(min(line_no) as bigint) as final_start_line, count(*) as line_count, origin_doc, cast(min(origin_line) as bigint) as origin_start_line
from g group by doc_id, source, origin_doc, line_no - origin_line, k
"""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="line_origins", description=__doc__.split("\n")[0])
    p.add_argument("documents")
    p.add_argument("output")
    p.add_argument("--config", default=CONFIG)
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("line_origins").getOrCreate()
    try:
        run(spark, args.documents, args.output, load(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Feed readers and table writers.

Readers return a one-column ``url`` DataFrame. Schemas are declared (no
inference pass over the data) except for the header-driven CSV feeds, whose
columns are only discovered by name (metadata, no data scan: every column is
read as a string). Missing sources are skipped, checked through the Hadoop
file system so the same code works on cluster storage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.strip() whitespace: Unicode White_Space plus the C0 separators.
_WS = r"[\p{IsWhite_Space}\x1c-\x1f]"


def _strip(c: F.Column) -> F.Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def url_column(columns: list[str]) -> str:
    """First column whose lowercase name contains 'url', else the first."""
    return next((c for c in columns if "url" in c.lower()), columns[0])


def read_phishing_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: CSV with header; rows with status='phishing' when that column exists."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if "status" in df.columns:
        df = df.filter(F.col("status") == "phishing")
    col = url_column(df.columns)
    return df.select(F.col(col).cast("string").alias("url")).filter(F.col("url").isNotNull())


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """A2: one URL per line; stripped lines starting with 'http'."""
    t = spark.read.text(path).select(_strip(F.col("value")).alias("url"))
    return t.filter(F.col("url").startswith("http"))


RANKED_SCHEMA = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("domain", T.StringType())])


def read_ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    """A3: headerless ``rank,domain`` CSV -> ``https://{domain}``."""
    df = spark.read.schema(RANKED_SCHEMA).option("header", False).csv(path)
    return df.filter(F.col("domain").isNotNull()).select(F.concat(F.lit("https://"), F.col("domain")).alias("url"))


def read_verified_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: CSV with header, malformed lines dropped; URL column picked by name."""
    # With column pruning the reader parses only the selected column and never
    # sees the extra fields of a bad line; this read needs every field parsed.
    cols = spark.read.option("header", True).csv(path).columns  # header only
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols]
                          + [T.StructField("_corrupt", T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
          .option("columnNameOfCorruptRecord", "_corrupt").csv(path))
    col = url_column(cols)
    # lines with a wrong field count are corrupt records: skipped
    return df.filter(F.col("_corrupt").isNull()).select(F.col(col).alias("url")).filter(F.col("url").isNotNull())


FEED_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("verified", T.StringType()),
                            T.StructField("online", T.StringType())])


def read_feed_json(spark: SparkSession, path: str, with_label: bool = False) -> DataFrame:
    """A5: (gzipped) JSON array of {url, verified, online}; verified & online."""
    df = spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(path)
    out = df.filter((F.col("verified") == "yes") & (F.col("online") == "yes")).select("url")
    return out.withColumn("label", F.lit(1)) if with_label else out


def read_feed_json_split(spark: SparkSession, path: str, with_label: bool = False) -> DataFrame:
    """A5 for large uncompressed arrays of flat objects: the text is read in records that end at
    a closing brace, so one array is as many splits as its size asks for (``read_feed_json``
    parses each file as a whole, in one task). A record that is no flat object (nested, or a brace in
    a text) fails the read instead of being lost.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.regexp_replace("value", r"^[\s,\[\]]+", "").alias("piece"))
    schema = T.StructType([*FEED_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    rec = F.from_json(F.concat("piece", F.lit("}")), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    df = pieces.filter("piece != ''").select(rec.alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    whole = F.when(broken, F.raise_error(F.lit("a feed record is no flat JSON object: read it with read_feed_json")).cast("boolean")).otherwise(True)
    out = df.filter(whole & (F.col("r.verified") == "yes") & (F.col("r.online") == "yes")).select("r.url")
    return out.withColumn("label", F.lit(1)) if with_label else out


def seed_legit_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """A user-supplied curated legit table, distinct."""
    return df.select(F.col(url).cast("string").alias("url")).dropDuplicates(["url"])


def path_exists(spark: SparkSession, path: str) -> bool:
    """A7 helper: existence through the Hadoop FileSystem of the path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


READERS = {
    "phishing_csv": read_phishing_csv,
    "url_lines": read_url_lines,
    "verified_csv": read_verified_csv,
    "feed_json": read_feed_json,
    "feed_json_split": read_feed_json_split,
    "ranked_domains": read_ranked_domains,
}
PHISHING_KINDS = ("phishing_csv", "url_lines", "verified_csv", "feed_json", "feed_json_split")
LEGIT_KINDS = ("ranked_domains",)


def read_all(spark: SparkSession, sources: list[tuple[str, str]], extra_legit: DataFrame | None = None):
    """A6 + A7 + D22: read every present source, skip missing ones.

    ``sources`` = [(kind, path)]. Returns (phishing urls, legit urls, counts)
    where counts has one row per source read (rows before de-duplication).
    """
    phish, legit, counted = [], [], []
    for kind, path in sources:
        if not path_exists(spark, path):
            continue
        df = READERS[kind](spark, path).select("url")
        (phish if kind in PHISHING_KINDS else legit).append(df)
        counted.append(df.select(F.lit(f"{kind}:{path}").alias("source")))
    if extra_legit is not None:
        legit.append(seed_legit_urls(extra_legit))
        counted.append(extra_legit.select(F.lit("curated_legit").alias("source")))
    empty = spark.createDataFrame([], "url string")
    p = reduce(lambda a, b: a.unionByName(b), phish) if phish else empty
    lg = reduce(lambda a, b: a.unionByName(b), legit) if legit else empty
    counts = (reduce(lambda a, b: a.unionByName(b), counted) if counted
              else spark.createDataFrame([], "source string"))
    return p, lg, counts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def read_all_observed(spark: SparkSession, sources: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, dict[str, Observation]]:
    """A7 + D22 in the same pass: the present sources of each class, and one observation per
    source. A source's rows are counted while whatever reads the frames runs (``get["n"]``
    afterwards): no job of its own, and no second scan.
    """
    frames: dict[bool, list[DataFrame]] = {True: [], False: []}
    seen = {}
    for kind, path in sources:
        if not path_exists(spark, path):
            continue
        name = f"{kind}:{path}"
        seen[name] = Observation(name)
        frames[kind in PHISHING_KINDS].append(READERS[kind](spark, path).select("url").observe(seen[name], F.count(F.lit(1)).alias("n")))
    empty = spark.createDataFrame([], "url string")
    phish, legit = (reduce(lambda a, b: a.unionByName(b), frames[k]) if frames[k] else empty for k in (True, False))
    return phish, legit, seen


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Dataset / feature / campaign / metrics / error sinks."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)

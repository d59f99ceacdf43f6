"""Sanctions lists: crypto addresses in remarks of delivered files, normalised and without repeats."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import Window as W

#: How the lists write addresses.
OFAC = r"(?:alt\.\s*)?Digital Currency Address\s*-\s*([A-Za-z]{2,10})\s+([A-Za-z0-9]+)"
EU_LABEL = r"\b(BTC|XBT|ETH|BSC|TRX|XMR|LTC|BCH|DOGE|XRP|USDT|USDC|SOL|BNB|DASH|ZEC|ETC|ARB)\s*:\s*([A-Za-z0-9]+)"
#: Currency and form of an address without a label, and the currency it counts under alone, if any.
EU_FORMS = (
    ("ETH", r"0x[a-fA-F0-9]{40}", None),
    ("BTC", r"bc1[a-z0-9]{25,62}", None),
    ("TRX", r"\bT[A-Za-z1-9]{33}\b", None),
    ("XMR", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", None),
    ("BTC", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "BTC"),
)
#: Letters and word boundaries of any script.
ANY_SCRIPT = "(?U)"
COLUMNS = T.StructType([T.StructField(c, T.StringType()) for c in ("address", "currency", "source", "list", "date")])


def currency(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return F.when(u == "XBT", "BTC").otherwise(u)


def _pairs(text: Column, regex: str) -> Column:
    """(currency, address) of every labelled address of a text."""
    part = lambda i: F.regexp_extract_all(text, F.lit(ANY_SCRIPT + regex), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("c"), part(2).alias("a")), lambda x: F.struct(currency(x["c"]).alias("currency"), x["a"].alias("address")))


def ofac_addresses(df: DataFrame, key: str, remark: str) -> DataFrame:
    """(key, pos, currency, address): every address of a remark in order; null remarks have none."""
    x = df.select(key, F.posexplode(_pairs(F.col(remark), OFAC)).alias("pos", "x"))
    return x.select(key, (F.col("pos") + 1).alias("pos"), "x.currency", "x.address")


def eu_addresses(df: DataFrame, key: str, block: str) -> DataFrame:
    """(key, line, currency, address) of a remark block, each once.

    A line with labelled addresses gives these alone, and its last label stays in force for the lines after it.  A line
    without gives what has the form of an address, under the label in force or, without one, under the currency of its form;
    a base58 address only while the label in force is BTC.  A capital word before a colon is no label unless it names a currency.
    """
    none = F.array().cast("array<struct<line:int,currency:string,address:string>>")
    start = F.struct(F.lit(None).cast("string").alias("now"), F.lit(0).alias("line"), none.alias("out"))

    def bare_of(line: Column, now: Column, cur: str, form: str, only: str | None) -> Column:
        found = F.transform(F.regexp_extract_all(line, F.lit(f"{ANY_SCRIPT}({form})"), F.lit(1)), lambda x: F.struct(F.coalesce(now, F.lit(cur)).alias("currency"), x.alias("address")))
        return found if only is None else F.when(now == only, found).otherwise(F.array().cast("array<struct<currency:string,address:string>>"))

    def step(a: Column, line: Column) -> Column:
        labels = _pairs(line, EU_LABEL)
        bare = F.concat(*[bare_of(line, a["now"], *form) for form in EU_FORMS])
        found = F.transform(F.when(F.size(labels) > 0, labels).otherwise(bare), lambda x: F.struct(a["line"].alias("line"), x["currency"].alias("currency"), x["address"].alias("address")))
        now = F.when(F.size(labels) > 0, F.element_at(labels, -1)["currency"]).otherwise(a["now"])
        return F.struct(now.alias("now"), (a["line"] + 1).alias("line"), F.concat(a["out"], found).alias("out"))

    lines = df.select(key, F.split(F.col(block), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]").alias("__lines"))
    return lines.select(key, F.explode(F.aggregate("__lines", start, step)["out"]).alias("x")).select(key, "x.line", "x.currency", "x.address").distinct()


def first_seen(df: DataFrame, address: str, order: list) -> DataFrame:
    """One row per address whatever its case: the first in the given order."""
    w = W.partitionBy(F.lower(F.trim(address))).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a CSV list; a missing, empty or malformed file, or one without addresses, gives none."""
    p = Path(path)
    local = "://" not in path
    if local and (not p.exists() or (p.is_file() and not p.stat().st_size)):
        return spark.createDataFrame([], COLUMNS)
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if "address" not in raw.columns:
        return spark.createDataFrame([], COLUMNS)
    have = [F.trim(F.col(f.name)).alias(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name) for f in COLUMNS]
    return raw.select(*have).filter("address is not null and address != ''")


def write_manifest(entries: DataFrame, path: str) -> None:
    """Entries (one a fetched file) as JSON lines; they come in as many files as ``entries`` has partitions."""
    entries.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def manifest_valid(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """(file, valid): whether each recorded file is in the folder with the recorded sha256, in either letter case."""
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("actual"))
    return files.join(there, "file", "left").select("file", F.coalesce(F.lower("sha256") == F.col("actual"), F.lit(False)).alias("valid"))


def eu_remarks(files: DataFrame, text: str = "value") -> DataFrame:
    """(n_entities, block): remark blocks of delivered XML texts, one text a row, and the number of entities of their text."""
    n = F.regexp_count(F.col(text), F.lit(r"<sanctionEntity\b"))
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<remark>(.*?)</remark>"), F.lit(1))
    return files.select(n.alias("n_entities"), F.explode(blocks).alias("block"))


def read_eu_remarks(spark: SparkSession, path: str) -> DataFrame:
    return eu_remarks(spark.read.text(path, wholetext=True))

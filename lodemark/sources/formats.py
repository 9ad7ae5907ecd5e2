"""Readers and writers of text formats, as column expressions and DataFrame sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of files that are scanned.
EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "go", "java", "rb", "rs", "cs", "php", "swift", "kt"]


def scannable(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")


def csv_line(*columns: str) -> Column:
    """A CSV line; values with a comma, quote or line feed are quoted, null is empty."""
    quoted = []
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted.append(F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *quoted)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_document(df: DataFrame, exported_at: str) -> DataFrame:
    """One row with {exported_at, count, data}, the rows in order; for exports within their row limit only."""
    return df.agg(F.to_json(F.struct(F.lit(exported_at).alias("exported_at"), F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(*df.columns))).alias("data"))).alias("document"))


def sarif_level(risk: Column) -> Column:
    return F.when(F.lower(risk).isin("critical", "high"), "error").when(F.lower(risk) == "medium", "warning").otherwise("note")


def sarif(findings: DataFrame, tool: str = "lodemark") -> DataFrame:
    """One SARIF 2.1.0 document for each ``report``: (report, path, id, label, severity, line)."""
    rule = F.struct(F.col("id"), F.struct(F.col("label").alias("text")).alias("shortDescription"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("label").alias("text")).alias("message"), F.array(place).alias("locations"))
    rows = findings.groupBy("report").agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return rows.select("report", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


_DEPENDENCY = "array<struct<name:string,version:string>>"


def npm_dependencies(content: Column) -> Column:
    """Name and version (without range signs) of a package manifest; empty if it is no JSON."""
    read = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    entries = lambda m: F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))
    both = F.concat(entries(read["dependencies"]), entries(read["devDependencies"]))
    return F.transform(both, lambda e: F.struct(e["key"].alias("name"), F.regexp_replace(e["value"], r"^[\^~>=<\s]+", "").alias("version")))


def requirements(content: Column) -> Column:
    """Name and version of each line that is no comment; unpinned ones have version *."""
    lines = F.filter(F.transform(F.split(content, r"\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    name = lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_.\-]+)", 1)
    version = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"[=~><!]=?\s*([0-9][0-9A-Za-z.\-]*)", 1), F.lit("")), F.lit("*"))
    return F.filter(F.transform(lines, lambda x: F.struct(name(x).alias("name"), version(x).alias("version"))), lambda d: d["name"] != "")


def go_modules(content: Column) -> Column:
    """Module and version of the require lines of a go.mod file."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:require\s+)?([\w./\-]+\.[\w./\-]+\s+v[0-9][\w.\-+]*)"), 1)
    return F.transform(found, lambda x: F.struct(F.split(x, r"\s+")[0].alias("name"), F.regexp_replace(F.split(x, r"\s+")[1], "^v", "").alias("version")))


def commit(line: Column) -> Column:
    """hash|name|email|ts|gpg|subject, where only the subject may hold the separator."""
    part = F.split(line, r"\|", 6)
    return F.struct(*[part[i].alias(n) for i, n in enumerate(["hash", "name", "email", "ts", "gpg", "subject"])])

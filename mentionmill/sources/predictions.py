"""Prediction tables, their file names, and report sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: File-name grammars of the two generations.
NAME_V2 = r"^(.*)_(?:gold_mentions|mention_pairs)?_?([^_]+)\((.*)\)_shots(\d+)_(.*)_(\d+)_(\d+)\.(?:csv|c_mp)$"
NAME_V1 = r"^(.+?)_(.+?)_shot(\d+)\((.+?)\)_beam(\d+)_(do|no)Sample\(t([\d.]+?)r(\d+)\)(?:\[(.*?)\])?(?:_.*)?\.(?:csv|txt)$"
SETTINGS_V1 = ("model", "data", "shots", "shot_type", "beam", "sample", "temperature", "repeats", "prompts")
SETTINGS_V2 = ("data", "model", "config", "shots", "template", "sample", "repeat")


def settings(name: str | Column, pattern: str = NAME_V1, fields: tuple[str, ...] = SETTINGS_V1) -> Column:
    """Struct of the settings in a file name; all null where the name does not fit."""
    n = F.col(name) if isinstance(name, str) else name
    fits = n.rlike(pattern)
    return F.struct(*[F.when(fits, F.regexp_extract(n, pattern, i)).alias(f) for i, f in enumerate(fields, 1)])


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def folder(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Names and sizes of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")


def without_partner(files: DataFrame, partners: DataFrame) -> DataFrame:
    """Files whose stem no partner file has; none are expected."""
    stem = lambda df: df.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
    return stem(files).join(stem(partners), "stem", "left_anti")


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and quoted line ends, all columns as text.

    The schema comes from the header line, so nothing is inferred and names
    with brackets work; a repeated name gets a number.
    """
    first = spark.read.text(path).first()
    names, seen = [], {}
    for n in next(csv.reader([first.value if first else ""]), []):
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    schema = StructType([StructField(n or f"_c{i}", StringType()) for i, n in enumerate(names)])
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, enforceSchema=True)


def read_predictions_v2(spark: SparkSession, path: str, template: str) -> DataFrame:
    """Pair rows with ``correct, valid, repeat`` of the column named after the template."""
    rows = read_quoted(spark, path)
    votes = F.from_json(F.col(f"`{template}`"), "array<int>")
    keep = [c for c in rows.columns if c != template and not c.startswith("_c")]
    got = rows.select(*[F.col(f"`{c}`").alias("scope" if c == "wd/cd" else c) for c in keep], F.lit(template).alias("template"), votes.alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    return got.withColumn("correct", at(0)).withColumn("valid", at(1)).withColumn("repeat", at(2)).drop("v").withColumn("label", F.col("label").cast("double").cast("int"))


def read_predictions_v1(spark: SparkSession, path: str) -> DataFrame:
    """``row, prompt, yes, valid, label`` in long form; header repeats and rows of totals are dropped.

    Prompt columns are those named ``Prompt n``; a repeat of a name holds cell labels and is left out.
    """
    rows = read_quoted(spark, path)
    prompts = [c for c in rows.columns if c.startswith("Prompt ") and c.split(" ", 1)[1].isdigit()]
    if not prompts:
        return spark.createDataFrame([], "row long, prompt int, yes int, valid int, label int, text string")
    label = F.expr("try_cast(label as double)").cast("int")
    base = rows.where("label is not null and label <> 'label'").withColumn("row", F.monotonically_increasing_id()).withColumn("_y", label)
    cells = F.array(*[F.struct(F.lit(int(c.split(" ")[1])).alias("prompt"), F.from_json(F.col(f"`{c}`"), "array<int>").alias("v")) for c in prompts])
    flat = base.where("_y is not null").select("row", F.explode(cells).alias("c"), F.col("_y").alias("label"), "text")
    return flat.where("c.v is not null").select("row", "c.prompt", F.get("c.v", F.lit(0)).alias("yes"), F.get("c.v", F.lit(1)).alias("valid"), "label", "text")


def normalise_v1(rows: DataFrame, model: str) -> DataFrame:
    """Results of one model in common columns, for ``unionByName``."""
    return rows.select(F.lit(model).alias("model"), "prompt", "yes", "valid", "label")


def read_headerless(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=False, schema=schema)


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet", by: str = "topic") -> None:
    """Pairs partitioned by topic (parquet), or as CSV with a header."""
    if fmt == "csv":
        pairs.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        pairs.write.mode("overwrite").partitionBy(by).parquet(path)


def prompt_log(prompts: DataFrame, number: str = "n", prompt: str = "prompt") -> DataFrame:
    """Log lines: a running number, a rule, and the prompt."""
    return prompts.select(F.col(number).alias("n"), F.concat(F.col(number).cast("string"), F.lit("##############\n"), F.col(prompt)).alias("value"))


def write_text(lines: DataFrame, path: str, order: str) -> None:
    lines.orderBy(order).select("value").write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Metric list or pivot as CSV."""
    scores.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latex_lines(report: DataFrame, order: list[str]) -> DataFrame:
    """``line, value`` of a LaTeX table of a report: every column as text, nulls empty, special characters escaped.

    Lines are numbered in the report's order; a report is small, one row for each template.
    """
    from pyspark.sql import Window

    special = lambda c: F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    names = " & ".join("".join("\\" + ch if ch in "&%$#_{}" else ch for ch in c) for c in report.columns)
    cells = [special(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in report.columns]
    number = F.row_number().over(Window.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    body = report.select((number + 1).cast("long").alias("line"), F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("value"))
    head = report.sparkSession.createDataFrame([(0, "\\begin{tabular}{" + "l" * len(report.columns) + "}"), (1, names + " \\\\")], "line long, value string")
    end = report.agg((F.count(F.lit(1)) + 2).alias("line")).select("line", F.lit("\\end{tabular}").alias("value"))
    return head.unionByName(body).unionByName(end)

"""Scans and sinks of labelled tables: ARFF, CSV, LibSVM, SVM-light, names/data, matrix, XML, text folders, series files, predictions.

Only headers come to the driver; rows stay in Spark.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+)", re.I)


def _unquote(x: str) -> str:
    x = x.strip()
    return x[1:-1].replace("\\'", "'") if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x


def arff_header(lines: list[str]) -> list[tuple[str, str]]:
    """(name, kind) of each attribute: numeric, nominal, string or date."""
    out = []
    for m in filter(None, (_ATTRIBUTE.match(x.strip()) for x in lines)):
        kind = m[2].strip().lower()
        out.append((_unquote(m[1]), "numeric" if kind.split()[0] in ("numeric", "real", "integer") else "nominal" if kind.startswith("{") else "date" if kind.startswith("date") else "string"))
    return out


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Dense or sparse rows; ``?`` is null; numeric columns are doubles, dates timestamps, others strings."""
    raw = spark.read.text(path).withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '%')")
    head = arff_header([r.value for r in raw.where(F.lower("value").startswith("@attribute")).collect()])
    data = raw.where(~F.startswith("value", F.lit("@")))
    kinds = {"numeric": T.DoubleType(), "date": T.TimestampType()}
    names = [f"_{i}" for i in range(len(head))]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    dense = F.from_csv("value", text.simpleString()[7:-1].replace(":", " "), {"quote": "'", "escape": "\\", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    inner = F.regexp_extract("value", r"^\{(.*)\}$", 1)
    pairs = F.transform(F.filter(F.split(inner, r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.split_part(F.trim(x), F.lit(" "), F.lit(1)).cast("int").alias("k"), F.regexp_replace(F.trim(x), r"^\S+\s+", "").alias("v")))
    sparse = F.map_from_entries(pairs)
    is_sparse = F.startswith("value", F.lit("{"))
    x = data.select(is_sparse.alias("sp"), F.when(~is_sparse, dense).alias("d"), F.when(is_sparse, sparse).alias("m"))
    cols = []
    for i, (name, kind) in enumerate(head):
        from_sparse = F.coalesce(F.element_at("m", F.lit(i)), F.lit("0") if kind == "numeric" else F.lit(None).cast("string"))
        v = F.when(F.col("sp"), F.nullif(from_sparse, F.lit("?"))).otherwise(F.col(f"d._{i}"))
        cols.append((v.cast(kinds[kind]) if kind in kinds else v).alias(name))
    return x.select(*cols)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir); on one machine a temporary one where none is set."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-scratch-")
        sc.setCheckpointDir(known)
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _label_list(df: DataFrame, column: str) -> str:
    labels = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column).collect()]
    return "{" + ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in labels) + "}"


def write_arff(df: DataFrame, path: str, relation: str = "data", nominal: tuple[str, ...] = ()) -> None:
    """A header part and data parts in one folder; the labels of ``nominal`` columns (few by nature) are listed, other strings have type string."""
    kind = lambda t: "numeric" if isinstance(t, T.NumericType) else "date" if isinstance(t, (T.TimestampType, T.DateType)) else "string"
    head = [f"@relation '{relation}'", *(f"@attribute '{f.name}' {_label_list(df, f.name) if f.name in nominal else kind(f.dataType)}" for f in df.schema.fields), "@data"]
    quoted = [F.coalesce(F.col(f.name).cast("string") if kind(f.dataType) == "numeric" else F.concat(F.lit("'"), F.regexp_replace(F.col(f.name).cast("string"), "(['\\\\])", r"\\$1"), F.lit("'")), F.lit("?")) for f in df.schema.fields]
    df.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(path)
    df.select(F.concat_ws(",", *quoted).alias("value")).write.mode("append").text(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, missing: str = "?", sep: str = ",", dates: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    r = spark.read.options(header=header, nullValue=missing, sep=sep, timestampFormat=dates)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, missing: str = "?", sep: str = ",") -> None:
    df.write.options(header=True, nullValue=missing, sep=sep).csv(path)


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(label, features map<int,double>); what follows # is dropped."""
    x = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''").select(F.split("v", r"\s+").alias("p"))
    entries = F.transform(F.filter(F.slice("p", F.lit(2), F.size("p")), lambda e: F.contains(e, F.lit(":"))), lambda e: F.struct(F.split_part(e, F.lit(":"), F.lit(1)).cast("int").alias("k"), F.split_part(e, F.lit(":"), F.lit(2)).cast("double").alias("v")))
    return x.select(F.col("p")[0].cast("double").alias("label"), F.map_from_entries(entries).alias("features"))


def write_svmlight(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    e = F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(e, " ")).alias("value")).write.text(path)


def read_names_data(spark: SparkSession, names: str, data: str) -> DataFrame:
    """A .names header (classes, then ``name: continuous.`` or labels) and its .data rows; the class comes last."""
    lines = [re.sub(r"\|.*", "", r.value).strip().rstrip(".") for r in spark.read.text(names).collect()]
    lines = [x for x in lines if x]
    fields = [(n.strip(), "double" if k.strip() == "continuous" else "string") for n, k in (x.split(":", 1) for x in lines[1:])]
    return spark.read.options(nullValue="?", ignoreLeadingWhiteSpace=True).schema(", ".join(f"`{n}` {k}" for n, k in [*fields, ("class", "string")])).csv(data)


def write_names_data(df: DataFrame, names: str, data: str, label: str) -> None:
    """A .names header (the class labels, then each attribute's kind or labels) and .data rows with the class last."""
    rest = [f for f in df.schema.fields if f.name != label]
    listed = lambda c: ", ".join(str(r[0]) for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect())
    lines = [f"{listed(label)}.", *(f"{f.name}: {'continuous' if isinstance(f.dataType, T.NumericType) else listed(f.name)}." for f in rest)]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(names)
    df.select(*(f.name for f in rest), label).write.option("nullValue", "?").csv(data)


def write_matrix(df: DataFrame, path: str, row: str = "row") -> None:
    df.select(F.concat_ws(" ", F.transform(row, lambda x: x.cast("string"))).alias("value")).write.text(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "instance") -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", "dataset").save(path)


def write_text_folders(df: DataFrame, path: str, label: str, text: str) -> None:
    """One folder a label; each text is a line of that folder's files, so line ends in it become spaces."""
    df.select(F.col(label).alias("label"), F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ").alias("value")).write.partitionBy("label").text(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(label, text): each sub-folder a class, each line of its files a document."""
    x = spark.read.option("recursiveFileLookup", True).text(path).withColumn("file", F.input_file_name())
    return x.select(F.regexp_extract("file", r"(?:label=)?([^/=]+)/[^/]+$", 1).alias("label"), F.col("value").alias("text"))


def write_series(df: DataFrame, path: str, label: str, series: str, sep: str = ",") -> None:
    df.select(F.concat_ws(sep, F.col(label).cast("string"), F.transform(series, lambda x: F.coalesce(x.cast("string"), F.lit("NaN")))).alias("value")).write.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("row"))


def read_xml(spark: SparkSession, path: str, row_tag: str = "instance") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_text_folders(spark: SparkSession, path: str) -> DataFrame:
    """(label, file, text): each sub-folder a class, each file a document."""
    x = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).withColumn("file", F.input_file_name())
    return x.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("label"), "file", F.col("value").alias("text"))


def read_series(spark: SparkSession, path: str, sep: str = r"[,\s]+") -> DataFrame:
    """(series_id, label, series): class first, then time points; ids number the lines in file order."""
    x = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("series_id"), F.split(F.trim("value"), sep).alias("p"))
    return x.select("series_id", F.col("p")[0].cast("double").cast("int").alias("label"), F.transform(F.slice("p", F.lit(2), F.size("p")), lambda v: F.when(F.isnan(v.cast("double")), None).otherwise(v.cast("double"))).alias("series"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(item, actual, predicted, probs) of a predictions file: three header lines, then ``actual,predicted,,p0,p1,...``."""
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("item"), "value").where(F.col("value").rlike(r"^[0-9.]+,[0-9.]+,,"))
    p = F.split("value", ",")
    return x.select("item", p[0].cast("double").cast("int").alias("actual"), p[1].cast("double").cast("int").alias("predicted"), F.transform(F.slice(p, F.lit(4), F.size(p)), lambda v: v.cast("double")).alias("probs"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.partitionBy("method", "dataset", "fold").parquet(path)


def write_prediction_text(df: DataFrame, path: str, dataset: str, method: str) -> None:
    """Three header lines (names, parameters, accuracy), then ``actual,predicted,,p0,p1,...``: the text form of predictions."""
    a = df.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0]
    df.sparkSession.createDataFrame([(f"{dataset},{method},test\nparameters\n{a}",)], "value string").coalesce(1).write.text(path)
    df.select(F.concat_ws(",", F.col("actual").cast("string"), F.col("predicted").cast("string"), F.lit(""), F.transform("probs", lambda p: p.cast("string"))).alias("value")).write.mode("append").text(path)


def set_label(df: DataFrame, column: str | None) -> DataFrame:
    """``df`` with the class last and named ``label``; None drops the class."""
    if column is None:
        return df.drop("label")
    return df.select(*(c for c in df.columns if c != column), F.col(column).alias("label"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """By extension; the class is the last column."""
    end = path.rsplit(".", 1)[-1].lower()
    return {"arff": read_arff, "csv": read_csv, "xml": read_xml, "parquet": lambda s, p: s.read.parquet(p), "libsvm": lambda s, p: s.read.format("libsvm").load(p)}[end](spark, path)

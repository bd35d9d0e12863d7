"""Reading documents, tables and question files; writing answers."""

from __future__ import annotations

import csv
import io
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names under which question files carry a question's id, text, right answer and kind.
QID = ("qid", "id", "question_id", "qID")
TEXT = ("question", "text", "prompt", "query")
GOLD = ("answer", "answer_gold", "gold", "expected")
KIND = ("answer_type", "type", "unit")
QUESTION_SCHEMA = "qid string, question string, answer_type string, gold double"


def walk(spark: SparkSession, root: str, glob: str = "*", *, content: bool = False) -> DataFrame:
    """(path, name, doc_id, length[, content]) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), "length", *(["content"] if content else []))
    return out.orderBy("name", "path") if not content else out


def find(files: DataFrame, name: str) -> DataFrame:
    """The first file with that name or stem."""
    return files.filter((F.col("name") == name) | (F.col("doc_id") == name)).orderBy("name", "path").limit(1)


def index(spark: SparkSession, root: str, shipped: str | None = None) -> DataFrame:
    """(doc_id, name, path) of a corpus: the index that came with it, else made from its files."""
    if shipped:
        try:
            return spark.read.csv(shipped, header=True)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return walk(spark, root).select("doc_id", "name", "path")


def text_of(texts: DataFrame, doc_id: str, key: str = "doc_id") -> str | None:
    """The text of one document, None where there is none."""
    row = texts.filter(F.col(key) == doc_id).select("text").first()
    return row["text"] if row else None


def save_store(tables: dict[str, DataFrame], root: str) -> None:
    """Every table as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def load_store(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def write_log(rows: DataFrame, path: str) -> None:
    """Whole answer rows (plan, reason, source) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def cached(texts: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Append to a Parquet table only what it doesn't hold yet, and read it."""
    spark = texts.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        texts.write.parquet(path)
        return spark.read.parquet(path)
    texts.join(have.select(key), key, "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet exported as CSV: blank headers and rows without any value go."""
    df = spark.read.csv(path, header=True)
    named = [c for c in df.columns if c.strip() and not c.startswith("_c")]
    return df.select(*[F.col(f"`{c}`") for c in named]).dropna(how="all")


def keyed_by_file(df: DataFrame, pattern: str, name: str) -> DataFrame:
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1))


def decode(raw: bytes) -> str:
    """Text of a file by its mark, else as strict UTF-8; zero bytes at every other place are UTF-16 without a mark, anything else is Latin-1."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    even, odd = raw[::2].count(0), raw[1::2].count(0)
    if 4 * max(even, odd) > len(raw) and len(raw) % 2 == 0:
        return raw.decode("utf-16-be" if even > odd else "utf-16-le")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _first(row: dict[str, Any], names: tuple[str, ...]) -> Any:
    return next((row[n] for n in names if row.get(n) not in (None, "")), None)


def parse_questions(raw: bytes) -> list[tuple[str, str, str | None, float | None]]:
    """Questions from a list, an envelope, one object, or JSON lines; rows without id are skipped, none at all is an error."""
    text = decode(raw).strip()
    try:
        data: Any = json.loads(text)
    except ValueError:
        data = []
        for line in text.splitlines():
            try:
                data.append(json.loads(line))
            except ValueError:
                continue
    if isinstance(data, dict):
        inner = next((data[k] for k in ("questions", "data", "items", "records", "rows") if isinstance(data.get(k), list)), None)
        data = inner if inner is not None else [data]
    out = []
    for row in data:
        if isinstance(row, dict) and (qid := _first(row, QID)) is not None:
            gold = _first(row, GOLD)
            out.append((str(qid), str(_first(row, TEXT) or ""), _first(row, KIND), None if gold is None else float(gold)))
    if not out:
        raise ValueError("no questions found")
    return out


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question file (driver-sized) read through Spark, so that any store works."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return spark.createDataFrame(parse_questions(bytes(raw)), QUESTION_SCHEMA)


def submission_text(rows: list[tuple[str, float | None]]) -> str:
    """CSV of answers: whole numbers without decimals, unknown ones empty."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["question_id", "answer"])
    for qid, a in rows:
        w.writerow([qid, "" if a is None else int(a) if float(a).is_integer() else a])
    return out.getvalue()


def write_answers(answers: DataFrame, path: str, *, allow_shrink: bool = False) -> None:
    """Overwrite answers unless fewer rows than before would be left."""
    spark = answers.sparkSession
    if not allow_shrink:
        try:
            before = spark.read.option("header", True).csv(path).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = 0
        if (now := answers.count()) < before:
            raise ValueError(f"{now} answers would replace {before}")
    number = F.when(F.col("answer") == F.floor("answer"), F.col("answer").cast("decimal(38,0)").cast("string")).otherwise(F.col("answer").cast("string"))
    answers.select(F.col("qid").alias("question_id"), number.alias("answer")).write.mode("overwrite").option("header", True).csv(path)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) of registered tables, one job."""
    counts = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))
        counts = one if counts is None else counts.unionByName(one)
    return counts

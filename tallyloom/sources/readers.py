"""CSV, page and answer sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.plans.reconcile import as_forms, as_ledger


def require_utf8(spark: SparkSession, path: str) -> None:
    """Raises ``ValueError`` if a line of the files isn't UTF-8.  One pass over the bytes, on the executors, up to the first such line."""
    if not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        raise ValueError(f"{path} isn't UTF-8")


def read_csv(spark: SparkSession, path: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Named columns of a UTF-8 CSV with a header, all text; order and further columns are free.

    Quoted line ends and doubled quotes are understood, a byte order mark is skipped, white space is kept.
    A column that the header lacks is an error, and so are bytes that aren't UTF-8, unless ``strict`` is false:
    then each becomes U+FFFD.  Blank cells are null here, see the callers.
    """
    if strict:
        require_utf8(spark, path)
    df = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("inferSchema", False).csv(path)
    )
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise KeyError(f"the header of {path} lacks {', '.join(lacking)}")
    return df.select(*columns)


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """Form readings of a CSV; ``seq`` follows the order of files and lines."""
    return as_forms(read_csv(spark, path, S.FORM_TEXT).withColumn("seq", F.monotonically_increasing_id()))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows of a CSV; blank and missing cells are empty texts."""
    return as_ledger(read_csv(spark, path, S.LEDGER))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers of the reading model, one JSON line or parquet row each."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes, str], list[str]], first_only: bool = True) -> DataFrame:
    """``filename, page_number, response_text, error`` of binary documents.

    ``extract`` gets a file's bytes and name and gives the answer for each page; it is the caller's
    connection to a reading model.  Its exceptions become rows with an error.  The result should be
    written before use, so that no answer is asked for twice.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                name = name.rsplit("/", 1)[-1]
                try:
                    answers = extract(bytes(content), name)
                    rows += [(name, i, a, None) for i, a in enumerate(answers[:1] if first_only else answers, 1)]
                except Exception as e:  # noqa: BLE001 - a page that can't be read is a result
                    rows.append((name, 1, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["filename", "page_number", "response_text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, "filename STRING, page_number INT, response_text STRING, error STRING")


def explode_pages(spark: SparkSession, path: str, split: Callable[[bytes], Iterable[bytes]], extract: Callable[[bytes, str], str]) -> DataFrame:
    """``filename, page_number, page_name, response_text, error``: one row for each page of each binary document.

    ``split`` gives the pages of a document one by one, each as a document of its own (the caller's page library);
    ``extract`` gets a page and its name (``page_01``) and gives the answer.  An exception of ``extract`` is the
    error of its page, and the other pages go on; one of ``split`` is the error of the page that it should have given.
    A document without pages gives no row.  The result should be written before use, so that no answer is asked for twice.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                n = 0
                try:
                    for n, page in enumerate(split(bytes(content)), 1):
                        answer = error = None
                        try:
                            answer = extract(page, f"page_{n:02d}")
                        except Exception as e:  # noqa: BLE001 - a page that can't be read is a result
                            error = str(e) or type(e).__name__
                        rows.append((name.rsplit("/", 1)[-1], n, f"page_{n:02d}", answer, error))
                except Exception as e:  # noqa: BLE001
                    rows.append((name.rsplit("/", 1)[-1], n + 1, f"page_{n + 1:02d}", None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["filename", "page_number", "page_name", "response_text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, "filename STRING, page_number INT, page_name STRING, response_text STRING, error STRING")

"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalar import Arg, text

DOWNLOADS = {"csv": ",", "tsv": "\t"}


def download(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as CSV or TSV with a header."""
    df.write.mode("overwrite").csv(path, sep=DOWNLOADS[kind], header=True)


def append_streams(df: DataFrame, path: str, keys: tuple[str, ...] = ("feed", "type"), most_records: int = 1_000_000, time: str | None = None, every: str = "hour") -> None:
    """Appends rows to a stream store, by feed and type; files roll over at most_records and, if a time column is given,
    with each second, minute, hour or day of it (the `rolled` folders)."""
    if time is not None:
        df = df.withColumn("rolled", F.date_format(F.date_trunc(every, F.col(time)), "yyyy-MM-dd'T'HHmmss"))
    df.write.mode("append").partitionBy(*keys, *(["rolled"] if time is not None else [])).option("maxRecordsPerFile", most_records).parquet(path)


def write_text(df: DataFrame, path: str, line: Column, header: str | None = None, footer: str | None = None) -> None:
    """Lines with an optional header and footer to each file."""
    lines = df.select(line.alias("value"))
    if header is None and footer is None:
        lines.write.mode("overwrite").text(path)
        return

    def framed(batches):
        import pyarrow as pa

        wrap = lambda s: pa.RecordBatch.from_pydict({"value": [s]})
        if header is not None:
            yield wrap(header)
        yield from batches
        if footer is not None:
            yield wrap(footer)

    lines.mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def json_line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def xml_element(df: DataFrame, tag: str = "record") -> Column:
    return F.to_xml(F.struct(*df.columns), {"rowTag": tag})


def merge_records(df: DataFrame, keys: list[str], position: str, record: Arg, separator: str = "\n") -> DataFrame:
    """Split records as one text a key again, in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), text(record).alias("r"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["r"]), separator).alias("merged"))


def to_kafka(df: DataFrame, servers: str, topic: str, key: Column, value: Column) -> None:
    """Rows to a Kafka topic (needs Spark's Kafka connector)."""
    df.select(key.cast("string").alias("key"), value.cast("string").alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def post_rows(df: DataFrame, url: str, body: Column, content_type: str = "application/json", together: int = 1, tries: int = 3) -> None:
    """Sends the rows' bodies by HTTP POST from the executors: `together` of them as lines of one request, over one
    connection a task. A request that fails is sent again, over a new connection; after so many tries the task fails."""

    def send(rows) -> None:
        from http.client import HTTPConnection, HTTPException, HTTPSConnection
        from itertools import islice
        from urllib.parse import urlsplit

        to = urlsplit(url)
        kind = HTTPSConnection if to.scheme == "https" else HTTPConnection
        path = (to.path or "/") + (f"?{to.query}" if to.query else "")
        rows, line = iter(rows), kind(to.netloc, timeout=30)
        while batch := list(islice(rows, together)):
            data = "\n".join(row.body for row in batch).encode()
            for attempt in range(tries):
                try:
                    line.request("POST", path, data, {"Content-Type": content_type})
                    answer = line.getresponse()
                    answer.read()
                    if answer.status < 400:
                        break
                    problem = f"status {answer.status}"
                except (OSError, HTTPException) as error:
                    problem = str(error)
                line.close()
                if attempt == tries - 1:
                    raise RuntimeError(f"POST to {url} failed: {problem}")
        line.close()

    df.select(body.cast("string").alias("body")).where("body is not null").foreachPartition(send)

"""Event folders written in parts, readers by extension, and Parquet scenarios."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloframe.operators import events as ev
from veloframe.sources import xml

#: Name parts of partitioned event files.
PART = re.compile(r"^(?P<stem>.*events)\.(?P<rank>\d+)\.(?P<kind>xml|xml\.gz|xml\.zst|parquet)$")


def event_files(folder: str) -> list[str]:
    """The parts of an event folder in order of their rank: one family of files with ranks from 0 without gaps; anything else is an error."""
    found = [(m["stem"], m["kind"], int(m["rank"]), str(p)) for p in Path(folder).iterdir() if (m := PART.match(p.name))]
    if not found:
        raise ValueError(f"no event files in {folder}")
    if len({f[:2] for f in found}) > 1:
        raise ValueError(f"several families of event files: {sorted({f[:2] for f in found})}")
    ranks = sorted(f[2] for f in found)
    if ranks != list(range(len(ranks))):
        raise ValueError(f"ranks aren't 0 to {len(ranks) - 1}: {ranks}")
    return [f[3] for f in sorted(found, key=lambda f: f[2])]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log by its extension: XML (plain, gz, zst) or Parquet."""
    if re.search(r"\.xml(\.gz|\.zst)?$", path):
        return xml.events(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of a folder as one log in order of time, part and place."""
    parts = [read_events(spark, f).drop("file") for f in event_files(folder)]
    return ev.merged(parts)


def filtered(df: DataFrame, condition: str) -> DataFrame:
    """A scan with a predicate; with Parquet it reaches the files' statistics."""
    return df.filter(condition)


def first_persons(elements: DataFrame, n: int) -> DataFrame:
    """The elements of the first n persons in the order of the file."""
    order = elements.select("person", "seq").distinct().orderBy("seq").limit(n)
    return elements.join(F.broadcast(order.select("person")) if n <= 100_000 else order.select("person"), "person", "left_semi")


def write_scenario(tables: dict[str, DataFrame], folder: str) -> None:
    """Scenario tables as Parquet, the engine's own binary format."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_scenario(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def id_table(kinds: dict[str, DataFrame]) -> DataFrame:
    """``kind, ord, id``: dense numbers of the ids of each kind in the order of ``seq``."""
    from functools import reduce

    parts = [ev.numbered(df.groupBy("id").agg(F.min("seq").alias("seq")), ["seq", "id"], "ord").select(F.lit(k).alias("kind"), "ord", "id") for k, df in kinds.items()]
    return reduce(DataFrame.unionAll, parts)


def fetched(url: str, timeout: float = 60.0) -> str:
    """A file behind http(s), copied to a temporary file on the driver; local paths stay as they are."""
    if not re.match(r"^https?://", url):
        return url
    import tempfile
    import urllib.request

    with urllib.request.urlopen(url, timeout=timeout) as src, tempfile.NamedTemporaryFile("wb", delete=False, suffix=Path(url).name) as to:
        to.write(src.read())
    return to.name

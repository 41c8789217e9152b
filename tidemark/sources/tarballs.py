"""Changes as gzip tar files of at most so many records, for a drop box."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import render


def pack_records(events: DataFrame, per_file: int = 2000, key: str = "_key") -> DataFrame:
    """Files as rows: name, records, content.  A file holds at most `per_file` records, each a member named by its
    key; files are numbered inside their partition, so no record is sorted or gathered with all others."""
    rows = render(events.withColumn("Key", F.col(key)), "old")
    named = rows.select("value", F.monotonically_increasing_id().alias("id"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held: list[tuple[int, str]] = []

        def flush():
            data = io.BytesIO()
            with tarfile.open(fileobj=data, mode="w:gz") as tar:
                for i, text in held:
                    info = tarfile.TarInfo(f"{i:020d}.ad")
                    body = text.encode()
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body))
            return pd.DataFrame({"name": [f"{held[0][0]:020d}.tar.gz"], "records": [len(held)], "content": [data.getvalue()]})

        for batch in batches:
            for value, i in zip(batch["value"], batch["id"], strict=True):
                held.append((i, value))
                if len(held) == per_file:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return named.mapInPandas(run, "name string, records long, content binary")

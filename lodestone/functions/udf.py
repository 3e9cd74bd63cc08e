"""User extension points: batch embedders, file parsers, and the chunk packer as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.corpus import pack
from lodestone.operators.extract import parse_files


def embed(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", out: str = "vector") -> DataFrame:
    """Documents with vectors of a user's embedder, which ``make`` builds once for each task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for part in batches:
            yield pd.Series(embedder(part.fillna("").tolist()))

    return docs.withColumn(out, vectors(F.col(text)))


def parse(files: DataFrame, fn: Callable[[str, str], list[tuple]], columns: str, names: list[str]) -> DataFrame:
    """A user's parser over every file; errors become a column, no bad file ends the job."""
    return parse_files(files, fn, columns, names)


@F.udtf(returnType="chunk: int, text: string")
class PackChunks:
    """``SELECT * FROM pack_chunks(array(...), 1500, 3000)``: greedy chunks of an array of elements."""

    def eval(self, elements: list, target: int, most: int):
        sizes = [len(e or "") for e in elements]
        number = pack(sizes, [True] * len(sizes), target, most)
        for k in dict.fromkeys(number):
            yield k, "\n".join(e or "" for e, n in zip(elements, number, strict=True) if n == k)


def register(spark) -> None:
    """Make the table function known to SQL."""
    spark.udtf.register("pack_chunks", PackChunks)

"""Table functions for SQL: segments of a text, and its n-grams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SEGMENT_WORDS = 1200


class Segments:
    def eval(self, text: str, most: int) -> Iterator[tuple[int, str, int]]:
        number, parts, n = 0, [], 0
        for p in (text or "").split("\n"):
            size = len(p.split())
            if not size:
                continue
            if n and n + size > most:
                yield number, "\n".join(parts), n
                number, parts, n = number + 1, [], 0
            parts.append(p)
            n += size
        if parts:
            yield number, "\n".join(parts), n


class Grams:
    def eval(self, text: str, n: int) -> Iterator[tuple[int, str]]:
        found = (text or "").split()
        for i in range(len(found) - n + 1):
            yield i, " ".join(found[i : i + n])


def register(spark: SparkSession) -> None:
    """segments(text, most) and grams(text, n) for LATERAL joins in SQL."""
    spark.udtf.register("segments", udtf(Segments, returnType="segment int, text string, n_words int"))
    spark.udtf.register("grams", udtf(Grams, returnType="pos int, gram string"))

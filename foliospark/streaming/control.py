"""Cancelling the jobs of a scope.

The reference behaviour is batch only; cancellation and progress are the whole control plane.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Cancelled(BaseException):
    """Not an Exception, so handlers of ordinary errors cannot turn a cancel into a partial result."""


class Scope:
    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.stopped = spark, f"foliospark-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.stopped:
            raise Cancelled(self.tag)


@contextlib.contextmanager
def cancellation_scope(spark: SparkSession) -> Iterator[Scope]:
    """Jobs started inside carry a tag; after scope.cancel() they end and Cancelled is raised."""
    scope = Scope(spark)
    spark.sparkContext.addJobTag(scope.tag)
    try:
        yield scope
        scope.check()
    except Exception as error:
        if scope.stopped:
            raise Cancelled(scope.tag) from error
        raise
    finally:
        spark.sparkContext.removeJobTag(scope.tag)

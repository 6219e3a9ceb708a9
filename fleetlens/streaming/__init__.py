"""Micro-batch ingest, sweeps and rollup refreshes, and their streaming queries."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(*writes: Callable[[], object]) -> list:
    """Run independent writes as concurrent Spark jobs; the first error is raised.

    The tables of one micro-batch are small and do not depend on each other, so their
    fixed costs overlap instead of adding up. The threads inherit the job group and the
    stream's properties, so stopping a stream cancels their jobs as well.
    """
    spark = SparkSession.active()
    jobs = [inheritable_thread_target(spark)(write) for write in writes]
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]

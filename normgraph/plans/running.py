"""Running queries with a time limit and measures of what they took."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from normgraph.operators.graph import TripleGraph
from normgraph.plans.sparql import parse
from normgraph.staging import Staged


class QueryTimeout(RuntimeError):
    """The query's jobs were cancelled at its time limit."""


@dataclass(frozen=True)
class Metrics:
    """Seconds of the phases of a query, and how large it and its result are."""

    parse: float
    plan: float
    execute: float
    patterns: int
    rows: int

    @property
    def total(self) -> float:
        return self.parse + self.plan + self.execute


def run(graph: TripleGraph, text: str, seconds: float | None = 30.0, compat: bool = False) -> tuple[DataFrame, Metrics]:
    """The result of a query, written to the shared folder, and its measures.

    After ``seconds`` its Spark jobs, which carry a tag of their own, are cancelled and :class:`QueryTimeout` is
    raised; None sets no limit. Other queries of the session go on.
    """
    from pyspark.sql import functions as F

    spark = graph.df.sparkSession
    began = time.perf_counter()
    query = parse(text)
    parsed = time.perf_counter()
    out = graph.query(query, compat=compat)
    planned = time.perf_counter()
    sc, tag = spark.sparkContext, f"query-{uuid.uuid4().hex}"
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.is_set():  # a query runs several jobs, one after the other
                sc.cancelJobsWithTag(tag)
                done.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    try:
        if seconds is not None:
            watcher.start()
        result = Staged(out, "result", n=F.count(F.lit(1)))
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"no result within {seconds} seconds") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
    where = query.where
    patterns = len(where.patterns) + sum(len(o.patterns) for o in where.optionals) if where else 0
    return result.df, Metrics(parsed - began, planned - parsed, time.perf_counter() - planned, patterns, result.seen["n"])

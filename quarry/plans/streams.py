"""The events table as a stream with keyed state, run to its end; each query has the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import scratch
from ..streaming import events as E
from ..streaming import keyed as K
from .registry import ORACLES, Tables, query

#: Moves between kinds of events that are allowed.
ALLOWED = {"signup": ("view", "click"), "view": ("click", "purchase", "error"), "click": ("view", "purchase", "error"), "purchase": ("view",), "error": ("view", "click")}


def _stream(t: Tables) -> DataFrame:
    """The table as a file stream; the pattern stands for one file or a folder of them."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")


def _drained(t: Tables, stream: DataFrame, base: str) -> DataFrame:
    E.drain(stream, f"{base}/out", f"{base}/state")
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(ORACLES["debounced_runs"])
def debounced_stream(t: Tables) -> DataFrame:
    """Runs of a user's events, given out by timers once a day has passed without another."""
    base = scratch(t.spark, "debounced")
    runs = K.debounced(K.closing(_stream(t), "ts", f"{base}/end"), "user_id", "ts", gap=86400, wait=5, most=15)
    return _drained(t, runs, base).where("user_id IS NOT NULL")


@query(ORACLES["fenced_writes"].replace("SELECT event_id, coalesce", "SELECT user_id, event_id, coalesce"))
def fenced_stream(t: Tables) -> DataFrame:
    """Writes of a generation that a later one has not overtaken, with the generation in state."""
    stream = _stream(t).withColumn("generation", F.floor("value"))
    return _drained(t, K.fenced(stream, "user_id", "ts", "event_id", "generation"), scratch(t.spark, "fenced"))


@query(ORACLES["illegal_transitions"])
def illegal_stream(t: Tables) -> DataFrame:
    """Moves that the table of states doesn't allow, with the last state of each user in state."""
    return _drained(t, K.illegal_moves(_stream(t), "user_id", "ts", "event_id", "event_type", ALLOWED), scratch(t.spark, "moves"))

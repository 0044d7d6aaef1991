"""Ritual progress kept up to date from a stream of study events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators.study import LISTEN_TARGET, READ_TARGET, RECITE_TARGET
from lectern.streaming.folds import fold_stream

STATE = "listen long, read long, recite long, link boolean"
ROWS = "seq long, listen_count long, read_count long, recite_count long, surah_link_done boolean, status string"


def live_ritual(events: DataFrame, targets=(LISTEN_TARGET, READ_TARGET, RECITE_TARGET)) -> DataFrame:
    """State of each (plan, page) after every event; the newest row is the current one."""
    listen, read, recite = targets

    def start():
        return {"listen": 0, "read": 0, "recite": 0, "link": False}

    def step(state, row):
        kind = row["kind"]
        if kind == "listen":
            state["listen"] = min(state["listen"] + 1, listen)
        elif kind == "read" and state["listen"] >= listen:
            state["read"] = min(state["read"] + 1, read)
        elif kind == "recite" and row["error_free"] and state["read"] >= read:
            state["recite"] = min(state["recite"] + 1, recite)
        elif kind == "surah-link" and state["recite"] >= recite:
            state["link"] = True
        status = "memorized" if state["link"] else "in-ritual"
        return [(row["seq"], state["listen"], state["read"], state["recite"], state["link"], status)]

    return fold_stream(events, ["plan_id", "page"], "seq", start, step, STATE, ROWS)

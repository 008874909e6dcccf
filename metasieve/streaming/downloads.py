"""The download cascade as a stream: each study's state is what its sources have answered so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metasieve.sources.documents import LEAST_BYTES, is_valid_file

#: What a source has answered.
UNKNOWN, FAILED, GOOD = 0, 1, 2
OUT = "study_id string, step string, source string"
STATE = "sources array<string>, answers array<int>, told string"


def cascade_step(sources: list[str], answers: list[int]) -> tuple[str, str | None]:
    """(next, source to fetch), (done, source with the file) or (failed, none): sources count strictly in order."""
    for source, answer in zip(sources, answers, strict=True):
        if answer != FAILED:
            return ("done" if answer == GOOD else "next"), source
    return "failed", None


def download_steps(events: DataFrame) -> DataFrame:
    """study_id, step (next, done, cached, failed), source: what to do for a study, told whenever it changes.

    events is a stream of study_id, kind and, by kind: `offer` has sources (array of names in order), `cache` has length,
    `answer` has source, status, length, content_type, head. An answer may come before its offer and out of order, and
    repeats change nothing; a study that is done, cached or failed tells nothing more.
    """
    ok = is_valid_file(F.col("status"), F.col("length"), F.col("content_type"), F.col("head"))
    rows = events.select("study_id", "kind", "sources", "source", F.when(F.col("kind") == "cache", F.coalesce(F.col("length") > LEAST_BYTES, F.lit(False))).otherwise(ok).alias("good"))

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sources, answers, told = state.get if state.exists else ([], [], "")
        known, offered, cached = dict(zip(sources, answers, strict=True)), None, False
        for f in frames:
            for kind, given, source, good in f.itertuples(index=False):
                if kind == "offer":
                    offered = list(given)
                elif kind == "cache":
                    cached |= bool(good)
                else:
                    known[source] = max(known.get(source, UNKNOWN), GOOD if good else FAILED)
        if told.startswith(("done", "failed", "cached")):
            return
        # an answer without an offer waits behind a mark
        order = offered if offered is not None else sources[: sources.index("|")] if "|" in sources else None
        if cached:
            now = ("cached", None)
        else:
            now = cascade_step(order, [known.get(s, UNKNOWN) for s in order]) if order is not None else None
        told_now = f"{now[0]} {now[1]}" if now else told
        held = [*order, "|"] if order is not None else []
        held += [s for s in known if s not in held and s != "|"]
        state.update((held, [known.get(s, UNKNOWN) for s in held], told_now))
        if now and told_now != told:
            yield pd.DataFrame({"study_id": [key[0]], "step": [now[0]], "source": [now[1]]})

    grouped = rows.groupBy("study_id")
    return grouped.applyInPandasWithState(lambda key, frames, state: step(key, (f[["kind", "sources", "source", "good"]] for f in frames), state), OUT, STATE, "update", GroupStateTimeout.NoTimeout)

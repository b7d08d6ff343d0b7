"""Access events as a stream: one load per path, whatever number of opens wait for it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.access import OPEN_PERM, checked
from ..ship import ship

_OUT = "ts timestamp, event_id bigint, pid int, path string, mask bigint, role string, decision string"
_COLUMNS = [c.split(" ")[0] for c in _OUT.split(", ")]


def _step(self_pid: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Rows go out as they come, but for the earliest open so far, which may be the one that loads."""
        loaded = state.get[0] if state.exists else False
        first: pd.DataFrame | None = None
        for rows in frames:
            if first is not None:
                rows = pd.concat([first, rows])
            own = rows["pid"] == self_pid
            asks = ~own & rows["pending"]
            can = asks & rows["available"]
            rows["role"] = "loaded"
            rows.loc[~asks, "role"] = "ready"
            rows.loc[own, "role"] = "self"
            rows.loc[asks & ~rows["available"], "role"] = "initiator"
            rows["decision"] = (own | ~rows["pending"] | rows["available"]).map({True: "allow", False: "deny"})
            if not loaded and can.any():
                rows, can = rows.reset_index(drop=True), can.reset_index(drop=True)
                at = rows[can].sort_values(["ts", "event_id"]).index[0]
                first = rows.loc[[at]]
                rows = rows.drop(index=at)
            yield rows[_COLUMNS]
        # A failed load leaves no trace, so that a later open tries again.
        if first is not None:
            state.update((True,))
            yield first.assign(role="initiator")[_COLUMNS]

    return run


def decide_stream(access: DataFrame, pending: DataFrame, blobs: DataFrame, self_pid: int) -> DataFrame:
    """The stream ``access(ts, event_id, pid, path, mask)`` with role and decision, as
    ``operators.access.decide`` gives them for a batch; state per path, one flag.

    Pending paths join as a static table. ``ts`` must be a timestamp with time zone."""
    ship(access.sparkSession)
    files = pending.select("path", "sha256").dropDuplicates(["path"]).join(
        blobs.select("sha256", F.lit(True).alias("available")).dropDuplicates(["sha256"]), "sha256", "left"
    )
    files = files.select("path", F.lit(True).alias("pending"), F.coalesce("available", F.lit(False)).alias("available"))
    rows = checked(access).join(files, "path", "left").withColumns({"pending": F.coalesce("pending", F.lit(False)), "available": F.coalesce("available", F.lit(False))})
    return rows.groupBy("path").applyInPandasWithState(_step(self_pid), _OUT, "loaded boolean", "append", GroupStateTimeout.NoTimeout)


# Kinds of events of a live stream.
PENDING, DONE, EVICT, OPEN = "pending", "done", "evict", "open"


def expand(control: DataFrame, files: DataFrame) -> DataFrame:
    """``control(ts, event_id, kind, volume_id)`` for each path of its volume in ``files(volume_id, path,
    sha256)``: a volume that comes (pending) or goes (evict) is one event for each of its paths."""
    rows = control.join(files.select("volume_id", "path", "sha256"), "volume_id")
    return rows.select("ts", "event_id", "kind", F.lit(None).cast("int").alias("pid"), "path", F.lit(None).cast("bigint").alias("mask"), "sha256")


def _live(self_pid: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, loaded = state.get if state.exists else (False, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        role, decision, keep = [], [], []
        for kind, pid, available in zip(rows["kind"], rows["pid"], rows["available"], strict=True):
            if kind == OPEN:
                keep.append(True)
                if pid == self_pid or not pending:
                    role.append("self" if pid == self_pid else "ready")
                    decision.append("allow")
                else:
                    role.append("loaded" if loaded else "initiator")
                    decision.append("allow" if loaded or available else "deny")
                    loaded = loaded or bool(available)
            else:
                keep.append(False)
                role.append("")
                decision.append("")
                pending, loaded = (kind == PENDING), False
        if pending:
            state.update((True, loaded))
        elif state.exists:
            state.remove()  # nothing is kept of paths that are done or whose volume is gone
        rows = rows.assign(role=role, decision=decision)[keep]
        yield rows[_COLUMNS].astype({"pid": "int32", "mask": "int64"})

    return run


def decide_live(events: DataFrame, blobs: DataFrame, self_pid: int) -> DataFrame:
    """The stream ``events(ts, event_id, kind, pid, path, mask, sha256)`` of opens and of changes of what
    is pending, with role and decision of each open.

    A path is pending from an event ``pending`` to one of ``done`` or ``evict``, which ends its state, so
    state is kept for pending paths alone. Events of a path count in the order of (ts, event_id) within
    a micro-batch, whose events of one path are held at once; micro-batches count as they come. ``sha256``
    is that of the file in every event of its path (opens too, from the manifest)."""
    ship(events.sparkSession)
    have = blobs.select("sha256", F.lit(True).alias("available")).dropDuplicates(["sha256"])
    opens = F.col("kind") != OPEN
    bad = F.raise_error(F.concat(F.lit("unexpected event mask "), F.col("mask").cast("string"))).cast("bigint")
    mask = F.when(opens | (F.col("mask").bitwiseAND(OPEN_PERM) != 0), F.coalesce("mask", F.lit(0).cast("bigint"))).otherwise(bad)
    rows = events.withColumns({"mask": mask, "pid": F.coalesce("pid", F.lit(-1))}).join(have, "sha256", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    return rows.groupBy("path").applyInPandasWithState(_live(self_pid), _OUT, "pending boolean, loaded boolean", "append", GroupStateTimeout.NoTimeout)

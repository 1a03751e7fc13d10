"""Version registry, locks and presence over tables of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("project", "asset", "representation")


def register(existing: DataFrame, requests: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Requests with version_number and outcome.

    ``requests`` has KEY, content_id, version (a number, or null for the next
    one) and seq, the order of arrival. Requests see those that arrived before
    them: a next version follows the latest one, explicit ones of the batch
    included, and of several claims on a number the first wins. Outcomes: ok,
    version_conflict for a number that is taken, and content_not_found for
    content that the store lacks; such a request takes no number.

    The latest number after request i is N(i) + max(latest, v(j) - N(j)) over
    explicit requests j up to i, where N counts next versions: two running
    aggregates in the order of arrival, so the requests of one key in a batch
    are ordered in one task (without being held in memory there).
    """
    key = list(KEY)
    latest = existing.groupBy(*key).agg(F.max("version_number").alias("_latest"))
    rows = requests
    if store is not None:
        rows = rows.join(store.select("content_id").distinct().withColumn("_found", F.lit(True)), "content_id", "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    else:
        rows = rows.withColumn("_found", F.lit(True))
    rows = rows.join(latest, key, "left").withColumn("_latest", F.coalesce("_latest", F.lit(0)).cast("long"))
    until = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_nexts", F.sum((F.col("version").isNull() & F.col("_found")).cast("long")).over(until))
    ahead = F.when(F.col("_found") & F.col("version").isNotNull(), F.col("version") - F.col("_nexts"))
    rows = rows.withColumn("_number", F.coalesce(F.col("version").cast("long"), F.col("_nexts") + F.greatest("_latest", F.max(ahead).over(until))))
    taken = existing.select(*key, F.col("version_number").cast("long").alias("_number")).distinct().withColumn("_taken", F.lit(True))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_found"), F.col("seq"))).over(Window.partitionBy(*key, "_number"))).join(taken, [*key, "_number"], "left")
    lost = F.col("_taken").isNotNull() | (F.col("_first") < F.col("seq"))
    out = rows.withColumn("outcome", F.when(~F.col("_found"), "content_not_found").when(F.col("version").isNotNull() & lost, "version_conflict").otherwise("ok"))
    return out.withColumn("version_number", F.when(F.col("outcome") == "ok", F.col("_number"))).select(*requests.columns, "outcome", "version_number")


def resolve(versions: DataFrame, uris: DataFrame) -> DataFrame:
    """``uris`` (project, asset, version_spec, representation) with content_id, filename and size, null if unknown."""
    latest = versions.groupBy(*KEY).agg(F.max_by(F.struct("content_id", "filename", "size"), "version_number").alias("found")).withColumn("version_spec", F.lit("latest"))
    exact = versions.select(*KEY, F.struct("content_id", "filename", "size").alias("found"), F.col("version_number").cast("string").alias("version_spec"))
    return uris.join(latest.unionByName(exact), [*KEY, "version_spec"], "left").select(*uris.columns, "found.*")


def latest_content(versions: DataFrame, artifact: str = "delivery") -> DataFrame:
    """(KEY, content_id) of the latest version; for ``dedup`` that of its chunked artifact, where it has one."""
    last = versions.groupBy(*KEY).agg(F.max_by(F.struct("content_id", "dedup_content_id"), "version_number").alias("v"))
    content = F.coalesce("v.dedup_content_id", "v.content_id") if artifact == "dedup" else F.col("v.content_id")
    return last.select(*KEY, content.alias("content_id"))


def sessions(heartbeats: DataFrame) -> DataFrame:
    """The last heartbeat of each (user_id, session_id), by (ts, event_id)."""
    rest = [c for c in heartbeats.columns if c not in ("user_id", "session_id")]
    last = heartbeats.groupBy("user_id", "session_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("h"))
    return last.select("user_id", "session_id", "h.*")


def _run(holder: int | None, actions, users) -> tuple[list, list, int | None]:
    """The holder before each request, its outcome, and the holder after all."""
    holders, outcomes = [], []
    for action, user in zip(actions, users):
        other = holder is not None and holder != user
        holders.append(holder)
        if action == "acquire":
            outcomes.append("held_by_other" if other else "acquired")
            holder = holder if other else user
        else:
            outcomes.append("not_found" if holder is None else "not_owner" if other else "released")
            holder = holder if other else None
    return holders, outcomes, holder


def lock_requests(requests: DataFrame) -> DataFrame:
    """(lock_key, user_id, action, ts, event_id) of requests in order with the holder before each, and the outcome.

    An acquire is refused while another user holds the lock, a release unless
    the user holds it; refused requests change nothing. Outcomes: acquired,
    held_by_other, released, not_owner and not_found.

    Requests of an hour are a block. What a block does to a holder is the same
    for all who release nothing in it, so it is summed up in a row for a free
    lock and one for each user who releases; only these are folded in order of
    a key, and each block then runs by itself from the holder before it.
    """
    rows = requests.select("lock_key", "user_id", "action", "ts", "event_id").withColumn("block", F.date_trunc("hour", "ts"))

    def effect(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["ts", "event_id"])
        users = block.user_id.tolist()
        sources = [None, *dict.fromkeys(u for u, a in zip(users, block.action) if a == "release")]
        targets = [_run(s, block.action, users)[2] for s in sources]
        return pd.DataFrame({"lock_key": key[0], "block": key[1], "source": pd.array(sources, "Int64"), "target": pd.array(targets, "Int64")})

    def fold(key: tuple, effects: pd.DataFrame) -> pd.DataFrame:
        holder, blocks, holders = None, [], []
        value = lambda x: None if pd.isna(x) else int(x)
        for block, own in effects.groupby("block", sort=True):
            blocks.append(block)
            holders.append(holder)
            holder = {value(s): value(t) for s, t in zip(own.source, own.target)}.get(holder, holder)
        return pd.DataFrame({"lock_key": key[0], "block": blocks, "start": pd.array(holders, "Int64")})

    def outcomes(key: tuple, block: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["ts", "event_id"])
        start = starts.start.iloc[0] if len(starts) else None
        holders, found, _ = _run(None if pd.isna(start) else int(start), block.action, block.user_id.tolist())
        return block.drop(columns="block").assign(holder=pd.array(holders, "Int64"), outcome=found)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    effects = rows.groupBy("lock_key", "block").applyInPandas(effect, f"lock_key {kinds['lock_key']}, block {kinds['block']}, source long, target long")
    starts = effects.groupBy("lock_key").applyInPandas(fold, f"lock_key {kinds['lock_key']}, block {kinds['block']}, start long")
    named = ", ".join(f"{c} {k}" for c, k in kinds.items() if c != "block")
    return rows.groupBy("lock_key", "block").cogroup(starts.groupBy("lock_key", "block")).applyInPandas(outcomes, f"{named}, holder long, outcome string")


def lock_holders(requests: DataFrame) -> DataFrame:
    """(lock_key, holder, last): who holds each lock after its last request, null if it is free, and that request's event_id."""
    done = lock_requests(requests)
    after = F.when(F.col("outcome") == "acquired", F.col("user_id")).when(F.col("outcome") != "released", F.col("holder"))
    last = done.groupBy("lock_key").agg(F.max_by(F.struct(after.alias("holder"), F.col("event_id").alias("last")), F.struct("ts", "event_id")).alias("l"))
    return last.select("lock_key", "l.holder", "l.last")

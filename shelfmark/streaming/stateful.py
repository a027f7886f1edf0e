"""Keyed streams: task progress, order commands, process audit, review counters, upserts.

Rows of one key inside a micro-batch are applied in (event time, sequence) order.
Events older than the last one applied are reported as ``late`` and not applied.
State can be given a time to live; streams with one, or with idle timers, use
processing time. The stateful streams need the RocksDB state store provider.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators import audit as A
from shelfmark.operators import order_log as L
from shelfmark.operators import orders as O
from shelfmark.operators import progress as P
from shelfmark.sources.sinks import upsert_latest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXT = "text string"


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One key's rows of this micro-batch, in order; a trigger bounds how many there are."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _JsonState(StatefulProcessor):
    """Keeps a JSON document and the last applied order key, with an optional time to live."""

    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.ttl_ms:
            self.state = handle.getValueState("state", TEXT, ttlDurationMs=self.ttl_ms)
        else:
            self.state = handle.getValueState("state", TEXT)

    def load(self) -> dict[str, Any] | None:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def save(self, doc: dict[str, Any]) -> None:
        self.state.update((json.dumps(doc),))

    def close(self) -> None:
        pass


PROGRESS_OUT = "conv string, seq bigint, late boolean, known string"
_ASKS = ("none", "verification_code", "return_reason", "confirmation")
_KNOWN = ", ".join(f"{c} bigint" if c.endswith("_at") else f"{c} string" for c in P.LASTS) + "".join(f", {m} int" for m in P.MAXIMA)


class LastSignals(_JsonState):
    """Keeps the latest signal of each kind and the largest of some; what a signal is was settled by column expressions."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        doc = self.load() or {"known": dict.fromkeys(P.MAXIMA, 0), "named": None, "asked": "none", "last": -1}
        out = []
        for e in _ordered(rows, ["seq"]).itertuples(index=False):
            late = e.seq <= doc["last"]
            if not late:
                switched = doc["named"] is not None and e.named_order is not None and e.named_order != doc["named"]
                ask = doc["asked"] if doc["asked"] in _ASKS else "none"
                told = json.loads(getattr(e, f"told_{ask}_{int(switched)}"))
                most = {m: max(doc["known"][m], told.pop(m)) for m in P.MAXIMA}
                doc = {
                    "known": {**doc["known"], **told, **most}, "named": e.named_order or doc["named"],
                    "asked": e.asked_now or doc["asked"], "last": int(e.seq),
                }
            out.append((key[0], int(e.seq), late, json.dumps(doc["known"], ensure_ascii=False)))
        self.save(doc)
        yield pd.DataFrame(out, columns=["conv", "seq", "late", "known"])


def task_progress(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``events(conv, seq, role, …)`` to a facts row per event: conv, seq, late, facts (JSON).

    The signals are the batch operator's own expressions, written out for every
    input that may have been asked for and for a switch of orders; state tells
    which of them holds. A late event is reported with the facts as they stand.
    """
    marks = P.event_marks()
    told = [
        F.to_json(F.struct(*[c.alias(n) for n, c in P.signals(F.lit(ask), F.lit(bool(switched)), "seq").items()])).alias(f"told_{ask}_{switched}")
        for ask in _ASKS
        for switched in (0, 1)
    ]
    prepared = events.select("conv", "seq", marks["named_order"].alias("named_order"), marks["asked"].alias("asked_now"), *told)
    known = prepared.groupBy("conv").transformWithStateInPandas(LastSignals(ttl_ms), PROGRESS_OUT, "append", "ProcessingTime" if ttl_ms else "None")
    facts = P.facts_of(known.select("conv", "seq", "late", F.from_json("known", _KNOWN).alias("k")).select("conv", "seq", "late", "k.*"), ["conv", "seq", "late"])
    names = [c for c in facts.columns if c not in ("conv", "seq", "late")]
    return facts.select("conv", "seq", "late", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("facts"))


class OrderProcessor(_JsonState):
    """Applies order commands; the first sight of an order opens it from its snapshot columns."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept, out = self.load(), []
        doc, last = (kept["order"], tuple(kept["last"])) if kept else (None, None)
        for row in _ordered(rows, ["ts", "seq"]).itertuples(index=False):
            at = (str(row.ts), int(row.seq))
            if last is not None and at <= last:
                out.append((int(row.seq), key[0], row.tool, False, False, False, "late_event", None if doc is None else doc["version"], True))
                continue
            state = O.open_order(row) if doc is None else O.OrderState(**{**doc, "items": tuple(doc["items"])})
            nxt, changed, error = O.apply_one(state, row)
            doc, last = nxt._asdict(), at
            out.append((int(row.seq), key[0], row.tool, error is None, changed, error is None and not changed, error, nxt.version, False))
        if doc is not None:
            self.save({"order": doc, "last": last})
        yield pd.DataFrame(out, columns=["seq", "order_id", "tool", "ok", "changed", "idempotent_replay", "error", "version", "late"])


ORDER_OUT = "seq bigint, order_id string, tool string, ok boolean, changed boolean, idempotent_replay boolean, error string, version int, late boolean"


def order_commands(commands: DataFrame, orders: DataFrame, users: DataFrame, as_of: str, ttl_ms: int | None = None) -> DataFrame:
    """A stream of commands against static orders and users.

    Blocked commands pass straight through; only commands that can change an
    order reach its state.
    """
    joined = O.with_records(commands.where(F.col("tool").isin(O.WRITE_TOOLS)), L.opened(orders), users).withColumn("static", O.static_error(as_of))
    live = joined.where(F.col("static").isNull()).select(
        "order_id", "ts", "seq", "tool", "status", "return_status", "exchange_status", "items", "shipping_address", "product_id", "order_payment",
        "payment_methods", "payment_method_id", "item_ids", "new_item_ids", "address",
    )
    return live.groupBy("order_id").transformWithStateInPandas(OrderProcessor(ttl_ms), ORDER_OUT, "append", "ProcessingTime" if ttl_ms else "None")


def blocked_commands(commands: DataFrame, orders: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    joined = O.with_records(commands.where(F.col("tool").isin(O.WRITE_TOOLS)), orders, users).withColumn("error", O.static_error(as_of))
    return joined.where(F.col("error").isNotNull()).select("seq", "order_id", "tool", "error")


class SimulationCollector(StatefulProcessor):
    """Keeps a simulation's messages until it ends (role ``end``) or is idle, then passes them on together."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None) -> None:
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", TEXT)
        self.closed = handle.getValueState("closed", "at bigint", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))
        self.seen = handle.getValueState("seen", "at bigint")

    def _release(self, sim: str) -> pd.DataFrame:
        texts = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        self.messages.clear()
        self.seen.clear()
        self.closed.update((1,))
        return pd.DataFrame({"sim": sim, "message": texts, "late": False}, columns=["sim", "message", "late"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            if self.closed.exists():
                yield pd.DataFrame({"sim": key[0], "message": part["message"], "late": True})
                continue
            self.messages.appendList([(m,) for m in part.loc[part["role"] != "end", "message"]])
            if (part["role"] == "end").any():
                yield self._release(key[0])
        if self.idle_ms and not self.closed.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            self.seen.update((now,))
            self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # a timer set before the last message is of no account; the last message set its own
        if self.seen.exists() and timerValues.getCurrentProcessingTimeInMs() - self.seen.get()[0] >= self.idle_ms:
            yield self._release(key[0])

    def close(self) -> None:
        pass


MESSAGE = "pos bigint, role string, content string, error boolean, calls array<struct<name:string,args:map<string,string>>>"


def completed_simulations(messages: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """All messages of a simulation once it is complete: sim, the message's columns, late.

    Messages of a simulation that was passed on already come out at once, as late.
    Without ``idle_ms`` a simulation ends with its ``end`` message only; ``ttl_ms``
    limits how long a passed-on simulation is remembered.
    """
    text = F.to_json(F.struct("pos", "role", "content", "error", "calls"))
    kept = messages.select("sim", "role", text.alias("message")).groupBy("sim").transformWithStateInPandas(
        SimulationCollector(idle_ms, ttl_ms), "sim string, message string, late boolean", "append", "ProcessingTime" if idle_ms or ttl_ms else "None"
    )
    return kept.select("sim", F.from_json("message", MESSAGE).alias("m"), "late").select("sim", "m.*", "late")


def process_audit(messages: DataFrame, deliver: Callable[[DataFrame, int], None], idle_ms: int | None = None, ttl_ms: int | None = None):
    """Audits every simulation as it completes, by the batch operator; ``deliver`` gets each micro-batch's verdicts."""

    def check(batch: DataFrame, batch_id: int) -> None:
        done = batch.where("not late").drop("late").persist()
        deliver(A.verdicts(done, A.audit(done)), batch_id)
        done.unpersist()

    return completed_simulations(messages, idle_ms, ttl_ms).writeStream.foreachBatch(check)


def drop_duplicate_simulations(sims: DataFrame, time: str, delay: str) -> DataFrame:
    """First copy of each simulation id within the watermark."""
    return sims.withWatermark(time, delay).dropDuplicatesWithinWatermark(["simulation_id"])


class ReviewCounter(StatefulProcessor):
    """Passes the first ``n`` reviews of a product."""

    def __init__(self, n: int, ttl_ms: int | None = None) -> None:
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used = self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:  # arrival order is kept; rows beyond the count are never gathered
            take = part.head(max(0, self.n - used))
            used += len(take)
            if len(take):
                yield take[["source_asin", "body", "line_no"]]
        self.seen.update((used,))

    def close(self) -> None:
        pass


def first_reviews(reviews: DataFrame, products: DataFrame, n: int = 5, min_chars: int = 30, ttl_ms: int | None = None) -> DataFrame:
    """Reviews of known products with enough text, the first ``n`` per product."""
    known = products.select("source_asin").distinct()
    usable = reviews.where(F.length("body") >= min_chars).join(known, "source_asin", "left_semi")
    return usable.groupBy("source_asin").transformWithStateInPandas(
        ReviewCounter(n, ttl_ms), "source_asin string, body string, line_no bigint", "append", "ProcessingTime" if ttl_ms else "None"
    )


def trajectory_upserts(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64):
    """Merge each micro-batch into the store at ``root``, which is split by ``bucket``, a hash of the trajectory id.

    Only the buckets a batch touches are read and written again, latest rows
    winning. A repeated batch gives the same rows, so retries change nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64("trajectory_id"), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # at most ``buckets``
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.parquet(root).where(F.col("bucket").isin(touched)).select(placed.columns)
        else:
            old = placed.limit(0)
        upsert_latest(old, placed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)

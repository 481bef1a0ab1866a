"""A sliding-log rate limiter: only admitted requests count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_MICROS = 60_000_000
LIMIT = 10
MAX_CLIENTS = 10_000
SHARDS = 200
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit(log: list[int], at: int, limit: int, window: int) -> tuple[bool, int]:
    """Whether a request at this time is admitted, and the seconds until another may be; keeps the log of admitted times."""
    while log and log[0] <= at - window:
        log.pop(0)
    if len(log) < limit:
        log.append(at)
        return True, 0
    return False, max(1, -(-(log[0] + window - at) // 1_000_000))


def limit_requests(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_MICROS) -> DataFrame:
    """client, request_id, admitted, retry_after of a batch. Takes client, request_id, micros.

    Admission depends on what was admitted before, which no window frame can
    say. Rows are dealt and sorted by client and stream through the
    function, which holds one client's admitted times inside the window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = None, []
        for batch in batches:
            out = []
            for key, request, at in zip(batch["client"], batch["request_id"], batch["micros"], strict=True):
                if key != client:
                    client, log = key, []
                out.append((key, request, *admit(log, at, limit, window)))
            yield pd.DataFrame(out, columns=["client", "request_id", "admitted", "retry_after"])

    kinds = requests.schema
    ordered = requests.select("client", "request_id", "micros").repartition("client").sortWithinPartitions("client", "micros", "request_id")
    return ordered.mapInPandas(run, f"client {kinds['client'].dataType.simpleString()}, request_id {kinds['request_id'].dataType.simpleString()}, admitted boolean, retry_after long")


def limit_stream(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_MICROS, expire: bool = True) -> DataFrame:
    """The same for a stream; each client's admitted times are its state, dropped when a window passes without requests.

    With expiry a query runs a batch after another to look for what has
    expired, and so never reaches the end of its data: run one that has to
    end, such as a replay, without.
    """

    def run(key, batches, state):
        log = list(state.get[0]) if state.exists else []
        out = []
        for batch in batches:
            for request, at in sorted(zip(batch["request_id"], batch["micros"], strict=True), key=lambda x: (x[1], x[0])):
                out.append((key[0], request, *admit(log, int(at), limit, window)))
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((log,))
            if expire:
                state.setTimeoutDuration(max(1, window // 1000))
        yield pd.DataFrame(out, columns=["client", "request_id", "admitted", "retry_after"])

    kinds = requests.schema
    schema = f"client {kinds['client'].dataType.simpleString()}, request_id {kinds['request_id'].dataType.simpleString()}, admitted boolean, retry_after long"
    return requests.select("client", "request_id", "micros").groupBy("client").applyInPandasWithState(run, schema, "log array<long>", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


class _Bounded(StatefulProcessor):
    """Admitted times of a shard's clients; at most `most` clients are known, of which the one that was admitted least lately makes room."""

    def __init__(self, limit: int, window: int, most: int, expire: bool, client: str):
        self._limit, self._window, self._most, self._expire, self._client = limit, window, most, expire, client

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = max(1, self._window // 1000) if self._expire else None
        self._log = handle.getMapState("log", f"client {self._client}", "micros array<bigint>", ttl)

    def handleInputRows(self, key, rows, timerValues):
        known = {k[0]: list(v[0]) for k, v in self._log.iterator()} if self._log.exists() else {}
        before, touched, out = set(known), set(), []
        requests = sorted(((int(at), request, client) for batch in rows for client, request, at in zip(batch["client"], batch["request_id"], batch["micros"], strict=True)), key=lambda x: (x[0], x[1]))
        for at, request, client in requests:
            log = known.get(client)
            if log is None:
                if len(known) >= self._most:
                    del known[min(known, key=lambda c: (known[c][-1], c))]
                log = known[client] = []
            out.append((client, request, *admit(log, at, self._limit, self._window)))
            touched.add(client)
        for client in before - set(known):
            self._log.removeKey((client,))
        for client in touched & set(known):
            self._log.updateValue((client,), (known[client],))
        yield pd.DataFrame(out, columns=["client", "request_id", "admitted", "retry_after"])

    def close(self) -> None:
        pass


def limit_stream_bounded(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_MICROS, clients: int = MAX_CLIENTS, shards: int = SHARDS, shard: Column | None = None, expire: bool = True) -> DataFrame:
    """limit_stream() with a bound on what is remembered, however many clients there are.

    Clients are dealt to shards (by hash, or by `shard`), each of which knows
    at most clients / shards of them: a new one takes the place of the one
    that was admitted least lately, ties to the smaller. With `expire`, what
    a window has passed over is dropped as well. The state is a map by client
    in the state store, to be read through the state data source. The
    session's state store has to be RocksDB.
    """
    kinds = requests.schema
    client, request = kinds["client"].dataType.simpleString(), kinds["request_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("client"), F.lit(shards)) if shard is None else shard
    dealt = requests.select(own.cast("int").alias("shard"), "client", "request_id", "micros")
    processor = _Bounded(limit, window, max(1, clients // shards), expire, client)
    return dealt.groupBy("shard").transformWithStateInPandas(processor, f"client {client}, request_id {request}, admitted boolean, retry_after bigint", "Append", "ProcessingTime" if expire else "None")

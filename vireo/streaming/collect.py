"""Collection of blocks as a stream: windows of so many snapshots in typed state, and a sink that shows an epoch whole or not at all."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from vireo.plans.provenance import canonical_json
from vireo.sources.blocks import BlockError, BlockSource
from vireo.sources.rest import AcquisitionError, Contract, EligibilityError, made, sanitised_payload

#: ``block`` is null for a rejected attempt; ``sequence`` orders the lines of the audit log.
ATTEMPTS = "sequence long, block string, record string"


class Windows(StatefulProcessor):
    """Consecutive snapshots of a collection until a block has them all.

    State ``progress`` has the number of the block being collected, the attempt, and where the last accepted block ended;
    ``snapshots`` those of the attempt so far. A snapshot that is late or poor rejects the attempt; the snapshots after it
    begin the next one. More attempts than the contract allows fail the query.
    """

    def __init__(self, contract: Contract, phase: str, key: bytes, first: int = 1, after: int = 0) -> None:
        self.contract, self.phase, self.key, self.first, self.after = contract, phase, key, first, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "number int, attempt int, until long")
        self.snapshots = handle.getListState("snapshots", "snapshot string, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, attempt, until = self.progress.get() if self.progress.exists() else (self.first, 1, self.after)
        held = [(json.loads(s), d) for s, d in self.snapshots.get()] if self.snapshots.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("sequence").itertuples():
            name = f"{self.phase}-{number:04d}"
            try:
                block = self._next(json.loads(r.payload), held, name, attempt, until)
            except (AcquisitionError, BlockError, ValueError) as e:
                record = {"block_id": name, "attempt": attempt, "outcome": "rejected", "error": type(e).__name__, "reason": str(e)}
                out.append((r.sequence, None, record | ({"counts": e.counts, "found": e.found} if isinstance(e, EligibilityError) else {})))
                held, attempt = [], attempt + 1
                if attempt > self.contract.attempts:
                    raise AcquisitionError(f"{name}: no good block in {self.contract.attempts} attempts") from e
                continue
            if block is not None:
                out.append((r.sequence, canonical_json(block).decode(), {"block_id": name, "attempt": attempt, "outcome": "accepted", "content_sha256": block["integrity"]["content_sha256"]}))
                held, number, attempt, until = [], number + 1, 1, block["snapshots"][-1]["api_time"]
        self.progress.update((number, attempt, until))
        if held:
            self.snapshots.put([(canonical_json(s).decode(), d) for s, d in held])
        else:
            self.snapshots.clear()
        yield pd.DataFrame([(s, b, canonical_json(r).decode()) for s, b, r in out], columns=["sequence", "block", "record"]).astype({"sequence": "int64", "block": "object", "record": "object"})

    def _next(self, payload: dict, held: list, name: str, attempt: int, until: int) -> dict | None:
        """Takes one payload in; the block, if it has all its snapshots now."""
        clean = sanitised_payload(payload, self.key)
        if clean["api_time"] <= (held[-1][0]["api_time"] if held else until):
            raise AcquisitionError("the source's time doesn't increase" if held else "the block overlaps one accepted before")
        found = len(clean["observations"])
        if found < self.contract.least:
            raise EligibilityError(len(held), found, self.contract.least, [len(s["observations"]) for s, _ in held])
        none = {"network_latency_ms": None, "rate_limit_remaining": None, "rate_limit_retry_after_seconds": None}
        held.append((clean | {"snapshot_index": len(held), "eligible_observations": found, "transport": none}, hashlib.sha256(canonical_json(payload)).hexdigest()))
        if len(held) < self.contract.snapshots:
            return None
        return made(self.contract, name, [s for s, _ in held], [d for _, d in held], attempt)

    def close(self) -> None:
        pass


def attempts(payloads: DataFrame, contract: Contract, phase: str, key: bytes, first: int = 1, after: int = 0) -> DataFrame:
    """Accepted blocks and rejected attempts of a stream of (collection, sequence, payload); collections are collected side by side, each of its own phase folder."""
    return payloads.groupBy("collection").transformWithStateInPandas(Windows(contract, phase, key, first, after), ATTEMPTS, "append", "None")


def collected(found: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """The sink for ``attempts`` of one collection: blocks in ``folder``, the audit log in its folder ``audit``, an epoch at a time."""
    found.sparkSession.dataSource.register(BlockSource)
    return found.writeStream.format("blocks").option("folder", folder).option("checkpointLocation", checkpoint).outputMode("append")

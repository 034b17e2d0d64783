"""State vectors over HTTP: token cache, bounded acquisition and a Python data source that streams snapshots.

The transport is any callable ``(method, url, **request) -> (status, headers, body)``, so nothing here needs a network.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from vireo.plans.provenance import canonical_json
from vireo.sources.blocks import SCHEMA, BlockError, Field, checked, sealed, valid_box

Transport = Callable[..., tuple[int, dict, bytes]]


class AcquisitionError(RuntimeError):
    """The source couldn't be read as asked."""


class EligibilityError(AcquisitionError):
    """A snapshot with too few usable rows; ``counts`` has those before it."""

    def __init__(self, index: int, found: int, least: int, counts: list[int]) -> None:
        super().__init__(f"snapshot {index} has {found} usable rows of {least}")
        self.index, self.found, self.least, self.counts = index, found, least, counts


@dataclass(frozen=True)
class Contract:
    """What a collection promises; blocks of one collection share it."""

    bbox: tuple[float, float, float, float]
    snapshots: int = 6
    interval: float = 5.0
    least: int = 32
    attempts: int = 4
    retry_delay: float = 60.0

    def __post_init__(self) -> None:
        if not valid_box(self.bbox):
            raise ValueError("impossible bounding box")
        bounds = {"snapshots": Field("whole", 2), "least": Field("whole", 1), "attempts": Field("whole", 1), "interval": Field("real", 0), "retry_delay": Field("real", 0)}
        wrong = [name for name, field in bounds.items() if not field.holds(getattr(self, name))]
        if wrong:
            raise ValueError(f"impossible {', '.join(wrong)}")


class Session:
    """Client-credential tokens, renewed half a minute before they lapse, and one renewed try after a refusal."""

    def __init__(self, transport: Transport, base: str, token_url: str | None = None, client: tuple[str, str] | None = None, clock: Callable[[], float] = time.time) -> None:
        self.send, self.base, self.token_url, self.client, self.clock = transport, base, token_url, client, clock
        self.token, self.until = "", 0.0

    def _headers(self, renew: bool = False) -> dict:
        if self.client is None:
            return {}
        if renew or self.clock() >= self.until - 30:
            status, _, body = self.send("POST", self.token_url, data={"grant_type": "client_credentials", "client_id": self.client[0], "client_secret": self.client[1]})
            try:
                got = json.loads(body)
                token, lifetime = got["access_token"], got.get("expires_in", 1800)
            except (ValueError, KeyError, TypeError) as e:
                raise AcquisitionError("unusable token") from e
            if not Field("real", 0).holds(lifetime) or not lifetime:
                raise AcquisitionError("a token without a lifetime")
            if status != 200 or not isinstance(token, str) or not token:
                raise AcquisitionError("no token")
            self.token, self.until = token, self.clock() + lifetime
        return {"Authorization": f"Bearer {self.token}"}

    def states(self, bbox: tuple[float, float, float, float]) -> tuple[dict, dict]:
        """The payload, and latency and rate limits of the request."""
        ask = dict(zip(("lamin", "lomin", "lamax", "lomax"), bbox, strict=True)) | {"extended": 1}
        for renew in (False, True):
            began = time.perf_counter()
            status, headers, body = self.send("GET", f"{self.base}/states/all", params=ask, headers=self._headers(renew))
            took = 1000 * (time.perf_counter() - began)
            if status != 401 or self.client is None:
                break
        wait = headers.get("X-Rate-Limit-Retry-After-Seconds", "")
        if status == 429:
            raise AcquisitionError(f"rate limit; retry after {wait or 'an unknown time'}")
        if status != 200:
            raise AcquisitionError(f"status {status}")
        try:
            payload = json.loads(body)
        except ValueError as e:
            raise AcquisitionError("the answer is no JSON") from e
        left = headers.get("X-Rate-Limit-Remaining", "")
        return payload, {"network_latency_ms": took, "rate_limit_remaining": int(left) if left.isdigit() else None, "rate_limit_retry_after_seconds": int(wait) if wait.isdigit() else None}


def salt(path: str) -> bytes:
    """The salt of a folder: 32 random bytes or more, readable by the owner alone, made once."""
    try:
        with open(path, "rb") as f:
            found = f.read()
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        found, part = os.urandom(32), f"{path}.{os.getpid()}"
        with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
            f.write(found)
        try:
            os.link(part, path)
        except FileExistsError:
            with open(path, "rb") as f:
                found = f.read()
        finally:
            os.unlink(part)
    if len(found) < 32:
        raise AcquisitionError("the salt is too short")
    return found


def acquire(session: Session, contract: Contract, block_id: str, sanitise: Callable[[dict], dict], attempt: int = 1, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A sealed block of consecutive snapshots; one that is late, early or poor rejects the attempt. ``sanitise`` turns a
    payload into ``{api_time, observations, rejected_incomplete_states}``."""
    snapshots, hashes = [], []
    for k in range(contract.snapshots):
        payload, transport = session.states(contract.bbox)
        hashes.append(hashlib.sha256(canonical_json(payload)).hexdigest())
        clean = sanitise(payload)
        if snapshots and clean["api_time"] <= snapshots[-1]["api_time"]:
            raise AcquisitionError("the source's time doesn't increase")
        found = len(clean["observations"])
        if found < contract.least:
            raise EligibilityError(k, found, contract.least, [len(s["observations"]) for s in snapshots])
        snapshots.append(clean | {"snapshot_index": k, "eligible_observations": found, "transport": transport})
        if k + 1 < contract.snapshots and contract.interval:
            sleep(contract.interval)
    return made(contract, block_id, snapshots, hashes, attempt)


def made(contract: Contract, block_id: str, snapshots: list[dict], hashes: list[str], attempt: int) -> dict:
    """The sealed block of these snapshots."""
    return sealed(
        checked(
            {
                "schema_version": SCHEMA, "block_id": block_id, "phase": block_id.partition("-")[0], "bbox": list(contract.bbox), "snapshots_per_block": contract.snapshots, "interval_seconds": contract.interval,
                "acceptance_policy": {"minimum_eligible_states": contract.least, "max_attempts_per_block": contract.attempts, "retry_delay_seconds": contract.retry_delay, "accepted_attempt": attempt},
                "snapshots": snapshots, "integrity": {"raw_response_sha256": hashes},
            }
        )
    )


def acquired(session: Session, contract: Contract, block_id: str, sanitise, after: int = 0, sleep=time.sleep, log: Callable[[dict], None] = lambda r: None) -> dict:
    """The first good block of at most ``contract.attempts`` attempts; every attempt is logged."""
    for attempt in range(1, contract.attempts + 1):
        try:
            block = acquire(session, contract, block_id, sanitise, attempt, sleep)
            if block["snapshots"][0]["api_time"] <= after:
                raise AcquisitionError("the block overlaps one accepted before")
        except (AcquisitionError, BlockError) as e:
            log({"block_id": block_id, "attempt": attempt, "outcome": "rejected", "error": type(e).__name__, "reason": str(e)} | ({"counts": e.counts, "found": e.found} if isinstance(e, EligibilityError) else {}))
            if attempt == contract.attempts:
                raise AcquisitionError(f"{block_id}: no good block in {attempt} attempts") from e
            sleep(contract.retry_delay)
        else:
            log({"block_id": block_id, "attempt": attempt, "outcome": "accepted", "content_sha256": block["integrity"]["content_sha256"]})
            return block
    raise AssertionError("unreachable")


def append_record(path: str, record: dict) -> None:
    """A line of JSON, on disk before this returns."""
    with open(path, "ab") as out:
        out.write(canonical_json(record) + b"\n")
        out.flush()
        os.fsync(out.fileno())


def sanitised_payload(payload: dict, key: bytes) -> dict:
    """One payload in plain Python, for acquisition on the driver; ``operators.sanitize`` has the same rules as columns."""
    at, states = payload.get("time"), payload.get("states") or []
    if not Field("whole", 1).holds(at):
        raise ValueError("payload time must be a whole number of at least 1")
    rows, seen, rejected = [], set(), 0
    import math
    import re

    for s in states:
        ok = isinstance(s, list) and len(s) >= 12 and isinstance(s[0], str) and re.fullmatch("[0-9a-fA-F]{6}", s[0]) and s[0].lower() not in seen
        numbers = []
        for k in (9, 10, 11) if ok else ():
            try:
                numbers.append(math.nan if s[k] is None or isinstance(s[k], bool) else float(s[k]))
            except (TypeError, ValueError):
                numbers.append(math.nan)
        if not ok or not all(map(math.isfinite, numbers)) or numbers[0] < 0:
            rejected += 1
            continue
        seen.add(s[0].lower())
        cell = lambda k: s[k] if len(s) > k else None  # noqa: B023, E731
        c = cell(17)
        rows.append({
            "track_key": hmac.new(key, s[0].lower().encode(), hashlib.sha256).hexdigest()[:24], "time_position": cell(3), "last_contact": cell(4), "longitude": cell(5), "latitude": cell(6), "baro_altitude": cell(7),
            "on_ground": cell(8), "velocity": numbers[0], "true_track": numbers[1] % 360.0, "vertical_rate": numbers[2], "geo_altitude": cell(13), "position_source": cell(16),
            "category": c if isinstance(c, int) and not isinstance(c, bool) and 0 <= c <= 20 else None,
        })
    return {"api_time": at, "observations": rows, "rejected_incomplete_states": rejected}


def fetch(session: Session, bbox: tuple[float, float, float, float], key: bytes) -> dict:
    """One live snapshot, sanitised: ``{api_time, observations, rejected_incomplete_states}``."""
    if not valid_box(bbox):
        raise ValueError("impossible bounding box")
    return sanitised_payload(session.states(bbox)[0], key)


class StateSource(DataSource):
    """``spark.readStream.format("states")``: a payload per micro-batch, from a transport named ``module:attribute``.

    Option ``history`` names a folder (a URI that every driver sees) where each payload is kept until its batch is
    committed, so that a query that starts again reads what it read before.
    """

    @classmethod
    def name(cls) -> str:
        return "states"

    def schema(self) -> str:
        return "sequence long, payload string"

    def simpleStreamReader(self, schema):  # noqa: N802
        return StateReader(self.options)


class StateReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        import importlib

        from pyarrow import fs

        module, _, attribute = options["transport"].partition(":")
        self.session = Session(getattr(importlib.import_module(module), attribute), options.get("base", ""))
        self.bbox = tuple(float(x) for x in options.get("bbox", "-90,-180,90,180").split(","))
        self.most = int(options.get("snapshots", 1 << 62))
        if "history" not in options:
            raise ValueError("option history must name a folder for the payloads that may be read again")
        self.fs, self.folder = fs.FileSystem.from_uri(options["history"])
        self.fs.create_dir(self.folder, recursive=True)

    def _path(self, k: int) -> str:
        return f"{self.folder}/{k:012d}.json"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sequence": 0}

    def _kept(self, k: int) -> str | None:
        try:
            with self.fs.open_input_stream(self._path(k)) as file:
                return file.read().decode()
        except FileNotFoundError:
            return None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        k = start["sequence"]
        if k >= self.most:
            return iter([]), start
        payload = self._kept(k)
        if payload is None:
            payload = json.dumps(self.session.states(self.bbox)[0])
            with self.fs.open_output_stream(self._path(k) + ".part") as out:
                out.write(payload.encode())
            self.fs.move(self._path(k) + ".part", self._path(k))  # whole or not at all
        return iter([(k, payload)]), {"sequence": k + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = [(k, self._kept(k)) for k in range(start["sequence"], end["sequence"])]
        if any(payload is None for _, payload in rows):
            raise AcquisitionError("the history has lost a payload that isn't committed")
        return iter(rows)

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            name = info.base_name.partition(".")[0]
            if name.isdigit() and int(name) < end["sequence"]:
                self.fs.delete_file(info.path)

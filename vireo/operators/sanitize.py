"""Eligibility of state rows, first-wins deduplication and pseudonyms, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vireo.operators.order import numbered

#: What a stored observation must never hold (fixed names).
FORBIDDEN = ("icao24", "callsign", "origin_country", "squawk")
IDENTITY = r"^[0-9a-fA-F]{6}\z"
#: Positions in a raw state row (fixed by the feed's format).
POSITIONS = {
    "identity": 0, "time_position": 3, "last_contact": 4, "longitude": 5, "latitude": 6, "baro_altitude": 7, "on_ground": 8, "velocity": 9, "true_track": 10,
    "vertical_rate": 11, "geo_altitude": 13, "position_source": 16, "category": 17,
}
MODELLED = ("velocity", "true_track", "vertical_rate")
SNAPSHOT = ("block_id", "snapshot_index")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def eligible(identity: Column, velocity: Column, track: Column, climb: Column) -> Column:
    """Never null: identity of six hexadecimal digits, three finite numbers, no negative speed."""
    ok = identity.isNotNull() & identity.rlike(IDENTITY) & finite(velocity) & finite(track) & finite(climb) & (velocity >= 0)
    return F.coalesce(ok, F.lit(False))


def valid_category(c: Column) -> Column:
    """Codes 0 to 20; all else is null, and the row stays."""
    return F.when(c.between(0, 20), c)


def usable_category(c: Column) -> Column:
    """Codes that tell classes apart: 2 to 20 without 13."""
    return F.coalesce(c.between(2, 20) & (c != 13), F.lit(False))


def pseudonym(identity: Column, salt: bytes) -> Column:
    """First 24 hex digits of HMAC-SHA256 of the lower-cased identity, from two digests."""
    key = salt.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.lower(identity), "UTF-8")), 256))), 256), 1, 24)


def sanitised(rows: DataFrame, by: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """``rows`` with ``accepted``: eligible and the first of its identity in its snapshot; an ineligible row claims nothing.

    Also obs_index, the place among the accepted rows of the snapshot (null for others).
    """
    good = eligible(F.col("identity"), F.col("velocity"), F.col("true_track"), F.col("vertical_rate"))
    marked = rows.withColumn("good", good)
    claim = Window.partitionBy(*by, "good", F.lower("identity")).orderBy("ordinal")
    marked = marked.withColumn("accepted", F.col("good") & (F.row_number().over(claim) == 1))
    marked = numbered(marked, [*by, "accepted"], "ordinal", "obs_index").withColumn("obs_index", F.when(F.col("accepted"), F.col("obs_index").cast("int")))
    return marked.drop("good").withColumn("category", valid_category(F.col("category")))


def counts(marked: DataFrame, by: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    return marked.groupBy(*by).agg(F.count_if("accepted").alias("eligible_observations"), F.count_if(~F.col("accepted")).alias("rejected_incomplete_states"))


def parsed_payloads(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """State rows from JSON payloads ``{time, states}`` kept with their JSON types: a row of another shape is rejected, not lost.

    Returns the other columns, api_time, ordinal and the named positions. A payload without states gives one row whose
    ordinal is null. ``time`` must be a whole number of at least 1, else the query fails.
    """
    keep = [c for c in payloads.columns if c != body]
    v = payloads.withColumn("v", F.parse_json(body))
    time = F.when(F.schema_of_variant(F.variant_get("v", "$.time", "variant")) == "BIGINT", F.try_variant_get("v", "$.time", "long"))
    v = v.withColumn("api_time", F.when(time >= 1, time).otherwise(F.raise_error(F.lit("payload time must be a positive whole number")).cast("long")))
    states = F.expr("try_variant_get(v, '$.states', 'array<variant>')")
    rows = v.select(*keep, "api_time", F.posexplode_outer(states).alias("ordinal", "s"))
    long_enough = F.expr("try_variant_get(s, '$[11]', 'variant')").isNotNull()

    def cell(k: int) -> Column:
        return F.expr(f"try_variant_get(s, '$[{k}]', 'variant')")

    def number(k: int) -> Column:
        x = cell(k)
        return F.when(~F.schema_of_variant(x).isin("BOOLEAN", "VOID"), F.expr(f"try_cast(try_variant_get(s, '$[{k}]', 'string') AS double)"))

    def typed(name: str, k: int) -> Column:
        if name == "identity":
            return F.when(F.schema_of_variant(cell(k)) == "STRING", F.expr(f"try_variant_get(s, '$[{k}]', 'string')"))
        if name == "category":
            return F.when(F.schema_of_variant(cell(k)) == "BIGINT", F.expr(f"try_variant_get(s, '$[{k}]', 'int')"))
        if name in MODELLED:
            return number(k)
        kind = {"on_ground": "boolean", "time_position": "long", "last_contact": "long", "position_source": "int"}.get(name, "double")
        return F.expr(f"try_variant_get(s, '$[{k}]', '{kind}')")

    named = [F.when(long_enough, typed(n, k)).alias(n) for n, k in POSITIONS.items()]
    return rows.select(*keep, "api_time", "ordinal", *named)


def forbidden_fields(schema) -> list[str]:
    """Paths of a schema, nested ones too, whose last name identifies an aircraft."""
    found, queue = [], [("", schema)]
    while queue:
        path, kind = queue.pop()
        if hasattr(kind, "fields"):
            for f in kind.fields:
                if f.name in FORBIDDEN:
                    found.append(f"{path}{f.name}")
                queue.append((f"{path}{f.name}.", f.dataType))
        elif hasattr(kind, "elementType"):
            queue.append((path, kind.elementType))
        elif hasattr(kind, "valueType"):
            queue.append((path, kind.valueType))
    return sorted(found)

"""Registries under governance, times of unknown unit, and engines that come from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar import plugins
from tidebar.plans import registry, widebase
from tidebar.plans.shared import folder
from tidebar.sources import bars as src
from tidebar.sources import governance, times

c = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _payload(table) -> dict:
    """A registry object of a table with a row a law."""
    laws = [{"law_id": r["law_id"], "name": r["law_id"].title(), "symbol": "GOLD", "anchor_tf": "M5", "validation_status": "PROVISIONAL", "tier": r["tier"], "side": "BUY", "conditions": {}, "effect": {}, "metrics": {"sample_size": r["sample_size"], "edge": r["edge"], "users": r["users"]}} for r in table.orderBy("law_id").collect()]
    return {"registry_schema_version": "1.1.0", "symbol": "GOLD", "anchor_tf": "M5", "laws": laws}


_SAME = " AND ".join(f"o.{f} IS NOT DISTINCT FROM n.{f}" for f in registry._FIELDS)
_DIFF = """SELECT count(*) FILTER (o.law_id IS NULL) AS added, count(*) FILTER (n.law_id IS NULL) AS removed, count(*) FILTER (o.law_id IS NOT NULL AND n.law_id IS NOT NULL AND NOT ({same})) AS changed, count(*) FILTER (o.law_id IS NOT NULL AND n.law_id IS NOT NULL AND {same}) AS unchanged FROM {a} FULL JOIN {b} ON o.law_id = n.law_id"""


@query(f"""{registry._RG}, dn AS ({_DIFF.format(same=_SAME, a='o', b='n')}), first AS (SELECT count(*) AS laws FROM o)
SELECT 1::BIGINT AS version, 'PUBLISH_REGISTRY' AS action, 0::BIGINT AS base, laws AS added, 0::BIGINT AS removed, 0::BIGINT AS changed, 0::BIGINT AS unchanged, NULL::BIGINT AS bytes_of, 'first' AS reason FROM first
UNION ALL SELECT 2, 'PUBLISH_REGISTRY', 1, added, removed, changed, unchanged, NULL, 'all events' FROM dn UNION ALL SELECT 3, 'ROLLBACK_REGISTRY', 2, removed, added, changed, unchanged, 1, 'as it was' FROM dn""")
def registry_versions(spark, d):
    """The audit of a registry: published, published anew while a second publisher on the old base is refused, and rolled back to its first bytes."""
    old, new = (_payload(t) for t in registry._registries(spark, d))
    book = governance.Registry(spark, folder(spark, "registry"), "GOLD", "M5")
    book.publish(old, 0, "first publisher", "first")
    book.publish(new, 1, "first publisher", "all events", governance.canonical_hash(new), allow_removals=True)
    try:
        book.publish(new | {"engine_version": "2"}, 1, "second publisher", "too late", allow_removals=True)
        raise AssertionError("two publishers on one base")
    except governance.RegistryError:
        pass
    book.rollback(1, "first publisher", "as it was")
    same = [n for n in (1, 2) if book.content(n) == book.content(3)]
    audit = book.audit().where(F.lit(len(same) == 1))
    return audit.select("version", "action", "base", "added", "removed", "changed", "unchanged", F.when(c("action") == "ROLLBACK_REGISTRY", F.lit(same[0])).cast("long").alias("bytes_of"), "reason")


_KINDS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": None, "text": None, "native": None}


@query(f"""WITH k(kind, step) AS (VALUES {', '.join(f"('{n}', {x or 1})" for n, x in _KINDS.items())}), t AS (SELECT kind, event_type AS symbol, event_id, value, make_timestamp((epoch_us(ts) // step) * step) AS event_time FROM events, k)
SELECT kind, symbol, event_time, event_id, value FROM t QUALIFY row_number() OVER (PARTITION BY kind, symbol, event_time ORDER BY event_id DESC) = 1""")
def found_times(spark, d):
    """The same ticks with their time in seconds, thousandths, millionths and thousand-millionths, as text and as a timestamp, under other names: found and conformed alike."""
    t = src.table(spark, d, "events").select(c("event_type").alias("symbol"), "event_id", "value", c("ts").cast("timestamp").alias("_t"))
    us = F.unix_micros("_t")
    forms = {"s": ("open_time", F.floor(us / 1_000_000)), "ms": ("date", F.floor(us / 1000).cast("double")), "us": ("timestamp", us), "ns": ("candle_time", us.cast("decimal(38,0)") * 1000), "text": ("date_time", F.date_format("_t", "yyyy-MM-dd HH:mm:ss.SSSSSS")), "native": ("datetime", c("_t"))}
    out = None
    for kind, (name, value) in forms.items():
        part = times.conformed(t.withColumn(name, value).drop("_t"), ["symbol"], [c("event_id")]).select(F.lit(kind).alias("kind"), "symbol", c("event_time").cast("timestamp_ntz").alias("event_time"), "event_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{widebase._SETUP} SELECT symbol, time, setup_side_context, setup_location_context, setup_event_context, energy_bucket FROM su")
def plugin_chain(spark, d):
    """The wide base by the chain of a plug-in, which is checked for its functions before it runs."""
    module = plugins.load(spark, "tidebar.plans.sample_engine", plugins.WIDE_STEPS)
    bars = src.event_bars(spark, d, "15 minutes")
    module.configure(lambda width: src.event_bars(spark, d, width))
    return plugins.run(module, bars, plugins.WIDE_STEPS).select("symbol", "time", "setup_side_context", "setup_location_context", "setup_event_context", "energy_bucket")

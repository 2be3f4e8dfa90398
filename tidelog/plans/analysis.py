"""The analysis as one plan: windows, dossiers and all reports of a set of enriched events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import DEFAULT, Catalog
from tidelog.operators import correlate, incidents, summary, tree, windows
from tidelog.operators.windows import small
from tidelog.schema import Params
from tidelog.sources.sinks import nested


def dossiers(events: DataFrame, params: Params, scope: tuple[str, ...] = (), catalog: Catalog = DEFAULT) -> DataFrame:
    """One row for each reported window, with its parts as arrays of structs.

    With a scope, each has its own history and its own list of windows; a row is named by scope and incident_id.
    """
    counts = windows.process_counts(events, params.seconds, scope)
    hosts = windows.host_counts(counts, scope)
    top = windows.top_incidents(windows.candidates(events, params, scope), scope=scope).cache()
    rows = incidents.incident_events(events, top, params, scope)
    parts = incidents.distributions(rows, scope, catalog)
    keys, key = [*scope, "host_key", "bucket"], [*scope, "incident_id"]
    shares = windows.contributors(windows.process_baselines(counts, params, scope), hosts, scope)
    processes = shares.join(small(top.select(*keys, "incident_id"), scope), keys).select(*key, "rank", "process", "count", "percent", "baseline", "baseline_windows", "cutoff", "ratio", "detected", "flagged")
    causes = incidents.hypotheses(rows, incidents.previous_categories(events, top, params, scope), scope, catalog)
    chains = incidents.auth_sequences(rows, scope)
    shown = incidents.evidence(rows, incidents.evidence_rows(rows, causes, chains, scope), scope)
    out = top.join(incidents.network_summary(rows, scope).drop("total"), key).withColumn("window_seconds", F.lit(params.seconds))
    names = {"categories": "category", "facilities": "facility", "severities": "severity", "messages": "template", "directions": "direction", "sources": "source", "destinations": "destination"}
    for name, field in names.items():
        out = nested(out, parts.filter(F.col("field") == field).drop("field"), name, key=key)
    refs = incidents.technique_table(events.sparkSession, catalog)
    refs = refs.groupBy("cause").agg(F.array_sort(F.collect_list(F.struct("technique", "name", "url", "condition"))).alias("mitre_refs"))
    for name, child, order in (("processes", processes, ("rank",)), ("suggestions", causes.join(F.broadcast(refs), "cause", "left").drop("evidence_at"), ("rank",)), ("sequences", chains.drop("rows_at"), ("rank",)), ("evidence", shown, ("timestamp", "source", "row") if "source" not in scope else ("timestamp", "row"))):
        out = nested(out, child, name, order, key)
    return out


def reports(events: DataFrame, params: Params, scope: tuple[str, ...] = (), catalog: Catalog = DEFAULT) -> dict[str, DataFrame]:
    """All result tables by name. Cache or write the enriched events before: each table reads them.

    With a scope, as ("source",), every table is made for each scope by itself.
    """
    found = windows.candidates(events, params, scope)
    shown = tree.latest_starts(tree.starts(events, scope), scope)
    bins = summary.chart(events, params.seconds, scope)
    of = lambda column, limit=None, skip=(): summary.distribution(events, column, limit, skip, scope, catalog)
    return {
        "totals": summary.totals(events, scope),
        "window_totals": windows.window_totals(found, scope),
        "incidents": dossiers(events, params, scope, catalog),
        "categories": of("category"),
        "severities": of("severity"),
        "facilities": of("facility"),
        "hosts": of("host_key", 20),
        "host_ips": of("host_ip", 20, ("unknown",)),
        "messages": of("template", 15),
        "processes": summary.process_messages(events, scope=scope),
        "associations": correlate.associations(events, scope),
        "cooccurrence": correlate.cooccurrence(events, params.seconds, scope),
        "starts": shown,
        "follow_ups": tree.follow_ups(events, shown, scope),
        "nearby": tree.nearby(events, shown, params.seconds, scope),
        "chart": summary.hot_bins(bins, found, scope),
    }

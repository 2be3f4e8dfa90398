"""Dossiers of the reported windows: distributions, hypotheses, login sequences and evidence.

The reported windows are few (their number is a limit of the report), so that their keys go to the events by
broadcast; events of a window are aggregated and ranked, never gathered in one row. Under a scope, windows are told
apart by scope and incident_id, and events always by source and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.catalog import DEFAULT, Catalog
from tidelog.functions.text import UNKNOWN
from tidelog.operators.places import AT, counted
from tidelog.operators.windows import bucket_of, small, usable
from tidelog.schema import LOOKBACK, MOST_EVIDENCE, Params
from tidelog.shared import cut

#: Distributions of a dossier: field, column, entries at most, and whether only events with an endpoint count.
FIELDS = (
    ("category", F.col, "category", None), ("facility", F.col, "facility", None), ("severity", F.col, "severity", None), ("template", F.col, "template", 10),
    ("direction", F.col, "network.direction", None), ("source", F.col, "network.src", 10), ("destination", F.col, "network.dst", 10),
)

def label(name: Column, catalog: Catalog = DEFAULT) -> Column:
    out = name
    for k, v in catalog.labels.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def incident_events(events: DataFrame, top: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    """The events of the reported windows, with incident_id. ``top`` has MOST_INCIDENTS rows at most, for each scope."""
    keys = [*scope, "host_key", "bucket"]
    rows = usable(events).withColumn("bucket", bucket_of(F.col("timestamp"), params.seconds))
    return rows.join(small(top.select(*keys, "incident_id"), scope), keys)


def previous_categories(events: DataFrame, top: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, incident_id, category, count) over the 12 windows before each reported window of the same host."""
    counts = usable(events).groupBy(*scope, "host_key", bucket_of(F.col("timestamp"), params.seconds).alias("bucket"), "category").agg(F.count(F.lit(1)).alias("n"))
    t = top.select(*[F.col(c).alias(f"_{c}") for c in (*scope, "host_key")], F.col("bucket").alias("_bucket"), "incident_id")
    same = [F.col(c) == F.col(f"_{c}") for c in (*scope, "host_key")]
    near = F.col("bucket").between(F.col("_bucket") - LOOKBACK * params.seconds, F.col("_bucket") - params.seconds)
    found = counts.join(small(t, scope), [*same, near]).groupBy(*scope, "incident_id", "category").agg(F.sum("n").alias("count"))
    return found if params.use_history else found.limit(0)


def distributions(rows: DataFrame, scope: tuple[str, ...] = (), catalog: Catalog = DEFAULT) -> DataFrame:
    """(scope, incident_id, field, name, label, count, percent, rank): the values of each field, by count, then first seen.

    Shares are of all events of the window, those of directions of the events with an endpoint. Empty
    addresses don't count, nor do directions of events without an endpoint.
    """
    key = [*scope, "incident_id"]
    network = (F.col("network.src") != "") | (F.col("network.dst") != "")
    pairs = []
    for field, col, name, _ in FIELDS:
        value = col(name)
        value = F.when(network, value) if field == "direction" else F.nullif(value, F.lit("")) if field in ("source", "destination") else value
        pairs.append(F.struct(F.lit(field).alias("field"), value.alias("name")))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.count_if(network).alias("with_endpoints"))
    base = [*dict.fromkeys((*key, *AT))]
    values = rows.select(*base, F.explode(F.array(*pairs)).alias("p")).select(*base, "p.field", "p.name").filter("name is not null")
    counts = counted(values, [*key, "field", "name"])
    rank = F.row_number().over(Window.partitionBy(*key, "field").orderBy(F.desc("count"), "first"))
    limit = F.lit(1 << 30)
    for field, _, _, most in FIELDS:
        limit = F.when(F.col("field") == field, most).otherwise(limit) if most else limit
    whole = F.when(F.col("field") == "direction", F.col("with_endpoints")).otherwise(F.col("total"))
    return (
        counts.withColumn("rank", rank).filter(F.col("rank") <= limit).join(small(sizes, scope), key)
        .select(*key, "field", "name", F.when(F.col("field") == "category", label(F.col("name"), catalog)).otherwise(F.col("name")).alias("label"), "count", F.bround(100 * F.col("count") / whole, 2).alias("percent"), "rank")
    )


def network_summary(rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, incident_id, total, with_endpoints, distinct_destinations, distinct_ports, host_ips)."""
    network = (F.col("network.src") != "") | (F.col("network.dst") != "")
    return rows.groupBy(*scope, "incident_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(network).alias("with_endpoints"),
        F.count_distinct(F.nullif("network.dst", F.lit(""))).alias("distinct_destinations"),
        F.count_distinct(F.when(network, F.col("network.dst_port"))).alias("distinct_ports"),
        F.array_sort(F.collect_set(F.when(F.col("host_ip") != UNKNOWN, F.col("host_ip")))).alias("host_ips"),
    )


def cause_table(spark, catalog: Catalog = DEFAULT) -> DataFrame:
    """(cause, title, kind, checks, category, min_count, min_percent, gate): a row for each category of each cause."""
    return spark.createDataFrame([(c.id, c.title, c.kind, [*c.checks], k, c.min_count, c.min_percent, c.gate) for c in catalog.causes for k in c.categories], "cause string, title string, kind string, checks array<string>, category string, min_count int, min_percent int, gate string")


def technique_table(spark, catalog: Catalog = DEFAULT) -> DataFrame:
    """(cause, technique, name, url, condition)."""
    of = {t.id: t for t in catalog.techniques}
    return spark.createDataFrame([(c.id, t, of[t].name, of[t].url, of[t].condition) for c in catalog.causes for t in c.mitre], "cause string, technique string, name string, url string, condition string")


def hypotheses(rows: DataFrame, previous: DataFrame, scope: tuple[str, ...] = (), catalog: Catalog = DEFAULT) -> DataFrame:
    """Causes whose rule and gate a window meets: counts, shares, comparison with before, reason, checks and first rows.

    rank orders a window's causes by share, then name.
    """
    spark = rows.sparkSession
    key = [*scope, "incident_id"]
    causes = F.broadcast(cause_table(spark, catalog))
    out_ = F.col("network.direction") == "outbound"
    matching = rows.join(causes, "category")
    facts = matching.groupBy(*key, "cause", "title", "kind", "checks", "min_count", "min_percent", "gate").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(out_).alias("outbound"),
        F.count_distinct(F.when(out_, F.nullif("network.dst", F.lit("")))).alias("destinations"),
        F.count_distinct(F.when(out_, F.col("network.dst_port"))).alias("ports"),
        F.count_if(F.col("category") == "service_failure").alias("failures"),
        F.count_if(F.col("category") == "scan_alert").alias("scans"),
    )
    totals = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    peers = matching.filter((F.col("gate") == "auth_peer") & (F.col("network.src") != "")).select(*dict.fromkeys((*key, *AT)), "cause", F.col("network.src").alias("peer"))
    peers = counted(peers, [*key, "cause", "peer"]).withColumnRenamed("count", "attempts")
    best = Window.partitionBy(*key, "cause").orderBy(F.desc("attempts"), "first")
    peers = peers.withColumn("r", F.row_number().over(best)).filter("r = 1").select(*key, "cause", "peer", "attempts")
    firsts = matching.withColumn("r", F.row_number().over(Window.partitionBy(*key, "cause").orderBy(*AT))).filter("r <= 5")
    firsts = firsts.groupBy(*key, "cause").agg(F.array_sort(F.collect_list(F.struct("r", "source", "row"))).alias("_first")).select(*key, "cause", F.transform("_first", lambda x: x["row"]).alias("evidence_rows"), F.transform("_first", lambda x: x.dropFields("r")).alias("evidence_at"))
    past = previous.groupBy(*key).agg(F.sum("count").alias("past_total"))
    past_of = previous.join(causes, "category").groupBy(*key, "cause").agg(F.sum("count").alias("past"))
    f = facts.join(totals, key).join(peers, [*key, "cause"], "left").join(past, key, "left").join(past_of, [*key, "cause"], "left").join(firsts, [*key, "cause"])
    share = 100 * F.col("count") / F.col("total")
    before = F.when(F.col("past_total") > 0, 100 * F.coalesce("past", F.lit(0)) / F.col("past_total"))
    gate = (
        F.when(F.col("gate") == "auth_peer", F.coalesce(F.col("attempts") >= 5, F.lit(False)))
        .when(F.col("gate") == "service_failure", F.col("failures") >= 2)
        .when(F.col("gate") == "scan_evidence", (F.col("scans") >= 3) | ((F.col("outbound") >= 10) & ((F.col("destinations") >= 10) | (F.col("ports") >= 10))))
        .otherwise(True)
    )
    why = (
        F.when(F.col("gate") == "auth_peer", F.format_string(" %d fallimenti con sorgente esplicita %s.", F.coalesce("attempts", F.lit(0)), F.coalesce("peer", F.lit(""))))
        .when(F.col("gate") == "service_failure", F.format_string(" %d errori/riavvii di servizio.", "failures"))
        .when((F.col("gate") == "scan_evidence") & (F.col("scans") >= 3), F.format_string(" %d segnalazioni esplicite di scansione.", "scans"))
        .when(F.col("gate") == "scan_evidence", F.format_string(" %d eventi in uscita, %d destinazioni e %d porte distinte.", "outbound", "destinations", "ports"))
        .otherwise("")
    )
    reason = F.concat(F.format_string("%d/%d eventi (%.1f%%). Regola: almeno %d eventi e %d%%.", "count", "total", F.bround(share, 1), "min_count", "min_percent"), why)
    kept = f.filter((F.col("count") >= F.col("min_count")) & (share >= F.col("min_percent")) & gate)
    out = kept.select(
        *key, "cause", "title", "kind", "checks", "count", F.bround(share, 2).alias("percent"), F.bround(before, 2).alias("baseline_percent"), F.bround(share - before, 2).alias("delta_pp"),
        reason.alias("reason"), F.when(share >= 60, "componente dominante").otherwise("contributo parziale").alias("support"), "evidence_rows", "evidence_at",
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("percent"), "cause")))


_PLACES = "array<struct<source:string,row:bigint>>"
#: Failures that a login must follow to end a sequence.
_LEAST_FAILURES = 3


def _stretches(logins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, steps): logins dealt out by range of key and time, so that those of one key lie in many stretches.

    steps: failures up to each login of the stretch, with the first one's time and the first four places, and the login.
    """
    place = ["timestamp", "_file", "row"]
    dealt = logins.repartitionByRange(*keys, *place).withColumn("part", F.spark_partition_id())
    ordered = Window.partitionBy(*keys, "part").orderBy(*place)
    dealt = dealt.withColumn("segment", F.count_if("ok").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    dealt = dealt.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "part", "segment").orderBy(F.col("ok"), *place)))
    segments = dealt.groupBy(*keys, "part", "segment").agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.min(F.when(~F.col("ok"), F.col("timestamp"))).alias("begin"),
        F.sort_array(F.collect_list(F.when(~F.col("ok") & (F.col("n") <= 4), F.struct("n", F.col("_file").alias("source"), "row")))).alias("firsts"),
        F.max(F.when(F.col("ok"), F.struct("timestamp", F.col("_file").alias("source"), "row"))).alias("success"),
    )
    step = F.struct("segment", "failures", "begin", F.transform("firsts", lambda x: x.dropFields("n")).alias("rows"), "success")
    return cut(segments.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(step)).alias("steps")))


def _open(n: Column, begin: Column, rows: Column) -> list[Column]:
    """Failures that no login has taken yet: their number, the first one's time and the first four places."""
    return [n.cast("long").alias("n"), begin.cast("timestamp").alias("begin"), rows.cast(_PLACES).alias("rows")]


def _step(a: Column, x: Column) -> tuple[tuple[Column, Column, Column], Column, tuple[Column, Column, Column]]:
    """After a step: (open failures with its own, whether its login takes them, what is open then)."""
    n, begin, rows = a["n"] + x["failures"], F.coalesce(a["begin"], x["begin"]), F.slice(F.concat(a["rows"], x["rows"]), 1, 4)
    ends = x["success"].isNotNull() & (n >= _LEAST_FAILURES)
    return (n, begin, rows), ends, (F.when(ends, 0).otherwise(n), F.when(~ends, begin), F.when(ends, F.array().cast(_PLACES)).otherwise(rows))


def _through(steps: Column, held: int) -> Column:
    """What a stretch does to ``held`` open failures before it (3: or more): (n, begin, rows, taken).

    taken: a login took what was open before; n is then what is open at the end, else what the stretch adds.
    """

    def fold(a: Column, x: Column) -> Column:
        _, ends, left = _step(a, x)
        return F.struct(*_open(*left), (a["taken"] | ends).alias("taken"))

    end = F.aggregate(steps, F.struct(*_open(F.lit(held), F.lit(None), F.array()), F.lit(False).alias("taken")), fold)
    return F.transform(F.array(end), lambda e: F.struct(*_open(F.when(e["taken"], e["n"]).otherwise(e["n"] - held), e["begin"], e["rows"]), e["taken"].alias("taken")))[0]


def _entries(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, entry): the failures open before each stretch, from what the stretches before it do, one after the other.

    A key has a row for each range that it lies in.
    """
    does = F.array(*(_through(F.col("steps"), k) for k in range(_LEAST_FAILURES + 1)))
    of_key = stretches.select(*keys, F.struct("part", does.alias("does")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s"), lambda a, b: a["part"] - b["part"]).alias("all"))
    none = F.struct(*_open(F.lit(0), F.lit(None), F.array()))

    def fold(a: Column, x: Column) -> Column:
        before, does = a["entry"], F.get(x["does"], F.least(a["entry"]["n"], F.lit(_LEAST_FAILURES)).cast("int"))
        n, begin, rows = before["n"] + does["n"], F.coalesce(before["begin"], does["begin"]), F.slice(F.concat(before["rows"], does["rows"]), 1, 4)
        after = F.struct(*_open(F.when(does["taken"], does["n"]).otherwise(n), F.when(does["taken"], does["begin"]).otherwise(begin), F.when(does["taken"], does["rows"]).otherwise(rows)))
        return F.struct(after.alias("entry"), F.concat(a["out"], F.array(F.struct(x["part"].alias("part"), before.alias("entry")))).alias("out"))

    kept = f"array<struct<part:int,entry:struct<n:bigint,begin:timestamp,rows:{_PLACES}>>>"
    found = F.aggregate("all", F.struct(none.alias("entry"), F.array().cast(kept).alias("out")), fold)["out"]
    return of_key.select(*keys, F.explode(found).alias("e")).select(*keys, "e.part", "e.entry")


def auth_sequences(rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Three or more failed logins from one address for one user, then a login: the first ten of each window.

    A login after fewer failures takes none of them away; one that ends a sequence takes them all. What a stretch of
    logins does depends on the failures open before it only by their number up to three: each stretch tells what it does
    to each, these are composed along a key's stretches, and then each stretch finds its sequences by itself.
    """
    key = [*scope, "incident_id"]
    keys = [*key, "src", "user"]
    logins = rows.filter(F.col("category").isin("auth_failure", "auth_success") & (F.col("network.src") != "") & (F.col("network.user") != ""))
    logins = logins.select(*key, F.col("network.src").alias("src"), F.col("network.user").alias("user"), "timestamp", F.col("source").alias("_file"), "row", (F.col("category") == "auth_success").alias("ok"))
    stretches = _stretches(logins, keys)
    chain = f"struct<failures:bigint,begin:timestamp,end:timestamp,rows:{_PLACES},end_at:struct<source:string,row:bigint>>"

    def fold(a: Column, x: Column) -> Column:
        (n, begin, rows_), ends, left = _step(a, x)
        made = F.struct(n.alias("failures"), begin.alias("begin"), x["success"]["timestamp"].alias("end"), F.concat(rows_, F.array(x["success"].dropFields("timestamp"))).alias("rows"), x["success"].dropFields("timestamp").alias("end_at"))
        return F.struct(*_open(*left), F.when(ends, F.concat(a["out"], F.array(made))).otherwise(a["out"]).alias("out"))

    begun = stretches.join(_entries(stretches, keys), [*keys, "part"])
    state = F.struct(*_open(F.col("entry.n"), F.col("entry.begin"), F.col("entry.rows")), F.array().cast(f"array<{chain}>").alias("out"))
    found = begun.select(*keys, F.explode(F.aggregate("steps", state, fold)["out"]).alias("c")).select(*keys, "c.*")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("end", "end_at"))
    out = found.withColumn("rank", rank).filter("rank <= 10").drop("end_at")
    return out.withColumn("rows_at", F.col("rows")).withColumn("rows", F.transform("rows_at", lambda x: x["row"]))


def evidence_rows(rows: DataFrame, causes: DataFrame | None = None, sequences: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, incident_id, source, row) of the 30 events shown for each window: those cited first, then the earliest.

    Without causes or sequences nothing is cited by them.
    """
    key = [*scope, "incident_id"]
    other = [c for c in key if c != "source"]
    cited_by = lambda df, part, column: df.select(*other, F.lit(part).alias("part"), F.col("rank").alias("a"), F.posexplode(column).alias("b", "x")).select(*other, "part", "a", "b", "x.source", "x.row")
    earliest = rows.withColumn("a", F.row_number().over(Window.partitionBy(*key).orderBy(*AT))).filter(F.col("a") <= MOST_EVIDENCE)
    cited = earliest.select(*other, F.lit(2).alias("part"), "a", F.lit(0).alias("b"), "source", "row")
    for part, df, column in ((0, causes, "evidence_at"), (1, sequences, "rows_at")):
        cited = cited if df is None else cited.union(cited_by(df, part, column))
    cited = cited.groupBy(*other, "source", "row").agg(F.min(F.struct("part", "a", "b")).alias("place"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("place", "source", "row"))
    return cited.withColumn("rank", rank).filter(F.col("rank") <= MOST_EVIDENCE).select(*other, "source", "row", F.col("rank").alias("evidence_rank"))


def evidence(rows: DataFrame, chosen: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The chosen events with their place, provenance and texts, these cut to 2,000 characters."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 2000)
    long = lambda c: F.length(F.coalesce(c, F.lit(""))) > 2000
    maps = [c for c in ("columns", "metadata") if c in rows.columns]
    too_long = long(F.col("raw")) | long(F.col("message"))
    if "columns" in maps:
        too_long = too_long | F.coalesce(F.exists(F.map_values("columns"), lambda x: F.length(x) > 2000), F.lit(False))
    other = [c for c in (*scope, "incident_id") if c != "source"]
    shown = rows.join(small(chosen, scope), [*other, "source", "row"])
    extra = [F.transform_values(c, lambda _, v: F.substring(v, 1, 2000)).alias(c) for c in maps]
    told = [cut(F.col(c)).alias(c) if c == "timestamp_original" else F.col(c) for c in ("line", "timestamp_source", "timestamp_original", "time_generated", "event_time", "column_sources") if c in rows.columns]
    return shown.select(*other, "source", "row", "evidence_rank", "timestamp", *told, "host", "host_ip", "process", "pid", "facility", "severity", "category", cut(F.col("message")).alias("message"), cut(F.col("raw")).alias("raw"), too_long.alias("text_truncated"), "network", *extra)

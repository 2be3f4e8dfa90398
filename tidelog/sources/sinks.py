"""Writers of results: tables, dossiers and diagnoses as JSON, tickets as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import DEFAULT, Catalog
from tidelog.functions.time import iso_utc
from tidelog.schema import Params


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: tuple[str, ...] = ()) -> None:
    """Each table as Parquet in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}")


def as_json(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, json): one JSON document for each row, of all its columns."""
    return df.select(*keys, F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}).alias("json"))


def write_json(df: DataFrame, folder: str) -> None:
    as_json(df).select("json").write.mode("overwrite").text(folder)


def nested(parent: DataFrame, child: DataFrame, name: str, order: tuple[str, ...] = ("rank",), key: list[str] | tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """``parent`` with the rows of ``child`` as an ordered array of structs. The children of a dossier are few."""
    fields = [c for c in child.columns if c not in key]
    less = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    pairs = F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*fields).alias("v")))
    rows = child.groupBy(*key).agg(F.transform(F.array_sort(pairs, less), lambda x: x["v"]).alias(name))
    kind = rows.schema[name].dataType
    return parent.join(rows, [*key], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


# Headings and sentences of tickets, here and in the body of ``ticket``.
_POLICY = "TimeGenerated ha precedenza; se assente o vuoto si usa EventTime. Se entrambi sono vuoti si usa il timestamp nel messaggio. Un valore non valido non viene sostituito. Le colonne [UTC] usano UTC; gli offset espliciti vengono convertiti in UTC."
_NOTE = "Stesso host, IP sorgente e utente nella finestra; verificare se l'accesso era autorizzato."


def ticket(dossier: DataFrame, report: DataFrame | None = None, params: Params = Params(), catalog: Catalog = DEFAULT) -> DataFrame:
    """(source where there is one, incident_id, ticket): a dossier in Markdown, for a person to check and complete.

    ``dossier`` is of ``plans.dossiers``. ``report``, of ``quality.report``, gives file, digest and the import's figures to
    dossiers made with the scope ("source",); without it, these lines are left out.
    """
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    utc = lambda c: iso_utc(F.timestamp_seconds(c))
    p = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    either = lambda c, other: F.when(c == "", other).otherwise(c)
    listed = lambda c, f, mark="\n": F.array_join(F.transform(c, f), mark)
    counted = lambda c: listed(c, lambda x: p(x["name"], " (", text(x["count"]), ")"), ", ")
    some = lambda c: F.nullif(c, F.lit(""))
    known = "source" in dossier.columns and report is not None
    if known:
        dossier = dossier.join(report.select("source", "sha256", "counts", "truncated", "records_read", "analyzed_records", "skipped"), "source", "left")
    begin, end = utc(F.col("bucket")), utc(F.col("bucket") + F.col("window_seconds"))
    past = F.col("baseline").isNotNull()
    history = F.when(
        past,
        p(
            "- Storico macchina: incluso (finestre precedenti dello stesso host nel file importato).\n- Baseline: ", F.format_string("%.2f", "baseline"), " eventi/finestra su ", text("baseline_windows"),
            " finestre precedenti.\n- Soglia finale host: ", text("cutoff"), " eventi; mediana precedente ", text("median"), ", MAD ", text("mad"), ".",
        ),
    ).otherwise(p("- Storico macchina: escluso. Nessun confronto con finestre precedenti.\n- Soglia assoluta: almeno ", text("cutoff"), " eventi nella finestra. Non dimostra uno spike relativo al passato."))
    spikes = listed(F.filter("processes", lambda x: x["detected"]), lambda x: p("- Spike processo ", x["process"], ": ", text(x["count"]), " eventi; baseline ", text(x["baseline"]), ", soglia ", text(x["cutoff"]), ", ", text(x["baseline_windows"]), " finestre di confronto."))

    def suggestion(x: Column) -> Column:
        before = F.when(x["delta_pp"].isNotNull(), p("  Quota precedente ", text(x["baseline_percent"]), "%; variazione ", F.format_string("%+.2f", x["delta_pp"]), " punti percentuali."))
        refs = listed(x["mitre_refs"], lambda r: p("  MITRE candidato ", r["technique"], " — ", r["name"], ": ", r["url"], ". Da validare: ", r["condition"]))
        return F.concat_ws("\n", p("- ", x["title"], ": ", x["reason"]), before, refs, some(listed(x["checks"], lambda c: p("  Verifica: ", c))))

    sequences = listed("sequences", lambda x: p("- Fallimenti seguiti da accesso riuscito: sorgente ", x["src"], ", utente ", x["user"], ", ", text(x["failures"]), " fallimenti; righe [", listed(x["rows"], text, ", "), f"]. {_NOTE}"))

    def shown(x: Column) -> Column:
        head = p("- Record ", text(x["row"]), ", riga finale ", text(x["line"]), ", ", iso_utc(x["timestamp"]), ", riferimento ", F.coalesce(x["timestamp_source"], F.lit("syslog")), ", ", x["process"], " [", x["severity"], "], facility ", x["facility"], ":")
        quoted = p("> ", F.regexp_replace(F.regexp_replace(x["raw"], "\r", ""), "\n", "\n> "))
        return F.concat_ws("\n", head, quoted, F.when(x["event_time"].isNotNull(), p("  EventTime UTC: ", iso_utc(x["event_time"]), ".")))

    quality = [
        p("- Qualità input: {", listed(F.map_entries("counts"), lambda x: p('"', x["key"], '": ', text(x["value"])), ", "), "}; limite eventi raggiunto: ", F.when(F.col("truncated"), "True").otherwise("False"), "."),
        p("- Import: ", text("analyzed_records"), " record analizzati su ", text("records_read"), " esaminati; ", text("skipped"), " esclusi per struttura CSV non valida."),
    ] if known else []
    body = F.concat_ws(
        "\n",
        p("# Analisi eventi syslog — ", F.col("host_key"), " — ", begin),
        F.lit(""), F.lit("Stato: bozza da verificare"), F.lit("Causa selezionata: da determinare"), F.lit(""), F.lit("## Osservazioni"),
        *([p("- File: ", F.regexp_extract("source", "([^/]*)$", 1)), p("- SHA-256 UTF-8 del contenuto analizzato: ", F.coalesce("sha256", F.lit("")))] if known else []),
        p("- Host: ", F.col("host_key"), "; HostIP: ", either(F.array_join("host_ips", ", "), "non disponibile")),
        p("- Finestra UTC: [", begin, ", ", end, ")"),
        p("- ", text("count"), " eventi; classificazione: ", F.col("kind"), "."),
        history,
        p("- Processi: ", listed("processes", lambda x: p(x["process"], " (", text(x["count"]), ")"), ", "), "."),
        F.lit("- Le percentuali seguenti hanno come denominatore tutti gli eventi di questo host nella finestra."),
        F.lit("\n## Tipi di eventi"),
        listed("categories", lambda x: p("- ", x["label"], ": ", text(x["count"]), "/", text("count"), " (", text(x["percent"]), "%).")),
        some(spikes),
        F.lit("\n## Contesto della finestra"),
        p("- Facility: ", counted("facilities")), p("- Livelli: ", counted("severities")),
        p("- Endpoint espliciti in ", text("with_endpoints"), " eventi; ", text("distinct_destinations"), " destinazioni e ", text("distinct_ports"), " porte distinte."),
        p("- Direzione: ", either(counted("directions"), "non determinabile")),
        p("- IP destinazione espliciti (primi 10): ", either(counted("destinations"), "non disponibili")),
        F.lit("\n## Ipotesi suggerite (non confermate)"),
        either(listed("suggestions", suggestion), "- Nessuna regola supera le soglie; causa da determinare."),
        F.when(F.size("sequences") > 0, p("\n## Sequenze osservate\n", sequences)),
        F.lit("\n## Evidenze (campione)\nI numeri di record sono riferimenti all'input; il testo qui sotto proviene dai log."),
        listed("evidence", shown),
        F.lit("\n## Limiti e verifiche richieste\n- I conteggi misurano eventi di log, non byte/pacchetti, banda o probabilità di compromissione."),
        F.lit("- HostIP identifica l'host del record; SRC/DST vengono estratti solo quando espliciti nel messaggio."),
        F.lit("- Confermare il picco con contatori di interfaccia, firewall, proxy o NetFlow e verificare la direzione."),
        F.when(past, "- Le finestre senza eventi sono trattate come zero: verificare continuità della raccolta e cambi del livello di logging.").otherwise("- Confronto storico disattivato: quote e ipotesi riguardano solo la finestra selezionata."),
        F.lit(f"- Riferimento temporale: {_POLICY}"),
        F.lit(f"- Tutti gli orari dell'analisi sono in UTC. Valori senza fuso nelle colonne [UTC]: UTC; negli altri campi: {params.naive_offset}. Date con slash: {params.date_order}."),
        *quality,
        p("- Evidenze mostrate ", text(F.size("evidence")), "/", text("count"), "; i testi oltre 2000 caratteri sono troncati."),
        F.lit(f"- Catalogo locale {catalog.version}; MITRE consultato il {catalog.reviewed}."),
        F.lit("\n## Impatto e note dell'analista\nDa completare: impatto misurato, verifiche effettuate, esito e responsabile.\n"),
    )
    return dossier.select(*(["source"] if "source" in dossier.columns else []), "incident_id", body.alias("ticket"))

"""The rule catalogue as data: categories of messages, causes built on them, and technique references.

A category has patterns, one of which must be found, and exclusions, none of which may be. The order of the categories is
their precedence. A cause holds for a window if its categories have at least ``min_count`` events and
``min_percent`` of the window, and its gate, if it has one, is met.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Category:
    id: str
    label: str
    patterns: tuple[str, ...]
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cause:
    id: str
    title: str
    kind: str
    categories: tuple[str, ...]
    min_count: int
    min_percent: int
    checks: tuple[str, ...]
    gate: str = ""
    mitre: tuple[str, ...] = ()


@dataclass(frozen=True)
class Technique:
    id: str
    name: str
    url: str
    condition: str


VERSION, REVIEWED = "2026-10-05.1", "2026-10-05"
#: Labels, patterns, thresholds and texts that results must agree on.
CATEGORIES = (
    Category(
        "dns_tunnel_alert",
        "Segnalazioni di tunnel DNS",
        (
            r"\b(?:dns tunnel(?:ing)?|tunnel dns|dns beacon(?:ing)?)\b.{0,100}\b(?:detected|suspected|alert|rilevato|sospetto)\b",
            r"\b(?:detected|suspected|alert|rilevato|sospetto)\b.{0,100}\b(?:dns tunnel(?:ing)?|tunnel dns|dns beacon(?:ing)?)\b",
        ),
        (
            r"\b(?:no|not|false positive)\b.{0,25}\b(?:dns tunnel|dns beacon)",
            r"\b(?:dns tunnel(?:ing)?|dns beacon(?:ing)?)\b.{0,40}\b(?:disabled|not detected|false positive)\b",
        ),
    ),
    Category(
        "scan_alert",
        "Segnalazioni di scansione",
        (
            r"\b(?:port[- ]scan|portscan|network scan|scansione (?:delle )?porte)\b",
        ),
        (
            r"\b(?:no|not|false positive)\b.{0,25}\b(?:port[- ]scan|network scan)",
        ),
    ),
    Category(
        "auth_failure",
        "Autenticazioni fallite",
        (
            r"\b(?:failed password|authentication fail(?:ed|ure)|invalid user|login failed|failed login|autenticazione fallita|password errata)\b",
            r"\b(?:login|authentication|autenticazione)\b.{0,60}\baccess denied\b",
        ),
    ),
    Category(
        "auth_success",
        "Autenticazioni riuscite",
        (
            r"\b(?:accepted (?:password|publickey)|authentication success(?:ful)?|login successful|session opened for user|accesso riuscito)\b",
        ),
    ),
    Category(
        "dns_error",
        "Errori DNS",
        (
            r"\b(?:nxdomain|servfail|temporary failure in name resolution|name or service not known)\b",
            r"\b(?:dns|resolver|risoluzione)\b.{0,100}\b(?:fail(?:ed|ure)?|error|timeout|timed out|errore)\b",
        ),
    ),
    Category(
        "firewall_deny",
        "Blocchi firewall",
        (
            r"\b(?:UFW (?:BLOCK|REJECT)|iptables.*(?:DROP|REJECT)|nftables.*(?:drop|reject)|firewall.*(?:deny|denied|drop|reject))\b",
            r"\b(?:action|verdict)=(?:deny|drop|reject|blocked)\b",
        ),
    ),
    Category(
        "network_retry",
        "Timeout e tentativi di riconnessione",
        (
            r"\b(?:connection (?:timed out|refused|reset)|network (?:is )?unreachable|no route to host|reconnect(?:ing)?|retry(?:ing)?|retries|ritenta|riconnessione)\b",
            r"\b(?:connect|socket|request)\w*\b.{0,60}\b(?:timeout|timed out)\b",
        ),
    ),
    Category(
        "service_failure",
        "Errori e riavvii di servizi",
        (
            r"\b(?:segfault|segmentation fault|oom-kill|out of memory|core dumped|main process exited|failed to start|restart counter|scheduled restart job|servizio fallito)\b",
        ),
    ),
    Category(
        "backup_sync",
        "Backup e sincronizzazione",
        (
            r"\b(?:backup|rsync|rclone|syncthing|replication|sincronizzazione)\b",
        ),
    ),
    Category(
        "update_download",
        "Aggiornamenti e download",
        (
            r"\b(?:apt-get|apt|dnf|yum|packagekit|unattended-upgrades|windows update)\b.{0,100}\b(?:download|upgrade|update|install|fetch|get)",
            r"\b(?:downloading (?:package|update)|aggiornamento|scaricamento)\b",
        ),
    ),
    Category(
        "scheduled_job",
        "Attività pianificate",
        (
            r"\b(?:cron|crond|anacron)\b.*\b(?:CMD|job|run)\b",
            r"\b(?:scheduled task|timer elapsed|attivit[aà] pianificata)\b",
        ),
    ),
    Category(
        "service_start",
        "Avvii dichiarati nei log",
        (
            r"^(?:started|starting|avviato|avvio)\s+",
            r"\b(?:process|service|daemon|server|processo|servizio)\b.{0,60}\b(?:started|starting|launched|avviato|avviata)\b",
        ),
    ),
    Category(
        "network_connection",
        "Connessioni di rete",
        (
            r"\b(?:SRC|DST|src_ip|dst_ip|saddr|daddr)=",
            r"\b(?:connection established|connected to|new connection|connessione stabilita)\b",
        ),
    ),
)
OTHER, OTHER_LABEL = "other", "Altri eventi / non classificati"
CAUSES = (
    Cause(
        "retry_loop",
        "Ciclo di retry o servizio remoto non raggiungibile",
        "operativa",
        ("network_retry",),
        5,
        30,
        (
            "Verificare disponibilità del servizio remoto, routing, proxy e timeout.",
            "Confrontare retry/backoff del processo con l'orario del picco e con i flussi di rete.",
        ),
    ),
    Cause(
        "dns_resolution",
        "Problema di risoluzione DNS",
        "operativa",
        ("dns_error",),
        5,
        25,
        (
            "Controllare resolver configurati, domini richiesti e risposte NXDOMAIN/SERVFAIL.",
            "Verificare cache, scadenze DNS e disponibilità del resolver; confrontare query e traffico misurato.",
        ),
    ),
    Cause(
        "firewall_policy",
        "Policy firewall o destinazione non consentita",
        "operativa",
        ("firewall_deny",),
        5,
        30,
        (
            "Verificare regola firewall e cambi recenti; leggere SRC/DST e porte nei messaggi.",
            "Stabilire se il traffico è in ingresso o uscita prima di attribuirlo al PC.",
        ),
    ),
    Cause(
        "credentials",
        "Credenziali scadute o configurazione di autenticazione errata",
        "operativa",
        ("auth_failure",),
        5,
        25,
        (
            "Identificare account, IP sorgente e applicazione che ripete i tentativi.",
            "Controllare rotazioni password, account di servizio e modifiche recenti.",
        ),
    ),
    Cause(
        "brute_force",
        "Tentativi ripetuti di autenticazione da approfondire",
        "sicurezza",
        ("auth_failure",),
        10,
        40,
        (
            "Confrontare utenti e IP sorgente con quelli autorizzati e cercare accessi riusciti successivi.",
            "Escludere account di servizio con password errata; i fallimenti non provano un attacco.",
        ),
        gate="auth_peer",
        mitre=("T1110",),
    ),
    Cause(
        "restart_loop",
        "Servizio instabile o ciclo di riavvii",
        "operativa",
        ("service_failure", "service_start"),
        5,
        30,
        (
            "Controllare crash, OOM, exit code, restart counter e unità systemd.",
            "Verificare se ogni riavvio causa riconnessioni o risincronizzazioni.",
        ),
        gate="service_failure",
    ),
    Cause(
        "backup",
        "Backup, replica o sincronizzazione pianificata",
        "operativa",
        ("backup_sync",),
        3,
        25,
        (
            "Confrontare orari, destinazioni e quantità di dati con i job autorizzati.",
            "Verificare job sovrapposti, full backup inattesi o tentativi ripetuti.",
        ),
    ),
    Cause(
        "updates",
        "Aggiornamenti software o download",
        "operativa",
        ("update_download",),
        3,
        25,
        (
            "Verificare manutenzioni pianificate, pacchetti e repository di destinazione.",
            "Confrontare gli orari con proxy, contatori di interfaccia o NetFlow.",
        ),
    ),
    Cause(
        "scheduled",
        "Attività automatica pianificata",
        "operativa",
        ("scheduled_job",),
        3,
        25,
        (
            "Controllare cron, timer e task pianificati nella finestra.",
            "Associare il comando al processo e verificare che il job sia autorizzato.",
        ),
    ),
    Cause(
        "scan",
        "Scansione di servizi o verifica automatica della rete",
        "sicurezza",
        ("scan_alert", "network_connection", "firewall_deny"),
        10,
        30,
        (
            "Verificare se la sorgente è uno scanner o un monitor autorizzato.",
            "Confermare direzione, porte e destinazioni con firewall/NetFlow; un'ampia distribuzione non prova attività ostile.",
        ),
        gate="scan_evidence",
        mitre=("T1046",),
    ),
    Cause(
        "dns_tunnel",
        "Segnalazione di comunicazione tramite tunnel DNS",
        "sicurezza",
        ("dns_tunnel_alert",),
        3,
        20,
        (
            "Verificare la segnalazione del sensore, query, domini e contenuto delle risposte DNS.",
            "Escludere strumenti autorizzati e falsi positivi prima di attribuire un canale di comando e controllo.",
        ),
        mitre=("T1071.004",),
    ),
)
TECHNIQUES = (
    Technique("T1110", "Brute Force", "https://attack.mitre.org/techniques/T1110/", "Fallimenti ripetuti con una sorgente esplicita nei messaggi; verificare tentativi sistematici e account coinvolti."),
    Technique("T1046", "Network Service Discovery", "https://attack.mitre.org/techniques/T1046/", "Segnalazioni esplicite di scansione oppure connessioni in uscita verso molte destinazioni o porte; verificare lo scopo della scansione."),
    Technique("T1071.004", "Application Layer Protocol: DNS", "https://attack.mitre.org/techniques/T1071/004/", "Segnalazioni esplicite di tunnel/beacon DNS; semplici errori DNS non soddisfano la regola."),
)


@dataclass(frozen=True)
class Catalog:
    """A rule catalogue: the given one, or another one of the same kind."""

    categories: tuple[Category, ...] = CATEGORIES
    causes: tuple[Cause, ...] = CAUSES
    techniques: tuple[Technique, ...] = TECHNIQUES
    other: str = OTHER
    other_label: str = OTHER_LABEL
    version: str = VERSION
    reviewed: str = REVIEWED

    @property
    def labels(self) -> dict[str, str]:
        return {**{c.id: c.label for c in self.categories}, self.other: self.other_label}


DEFAULT = Catalog()

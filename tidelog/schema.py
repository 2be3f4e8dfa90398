"""Job parameters and the columns of an event."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tidelog.functions.time import offset_seconds

#: Windows compared with, fewest of them for a spike, windows reported.
LOOKBACK, LEAST_BASELINE, MOST_INCIDENTS = 12, 3, 50
#: Evidence rows of an incident, examples of a diagnostic.
MOST_EVIDENCE, MOST_EXAMPLES = 30, 5

#: Names by which each field may stand in a header, in order of preference (normalised).
ALIASES = {
    "timestamp": ("timegenerated[utc]", "timegenerated", "timestamp", "time", "datetime", "date", "@timestamp", "data", "ora"),
    "event_time": ("eventtime[utc]", "eventtime"),
    "host": ("computer", "hostname", "host", "machine"),
    "facility": ("facility", "syslogfacility"),
    "severity": ("securitylevel", "seceritylevel", "severity", "level", "priority", "loglevel"),
    "message": ("syslogmessage", "message", "msg", "event", "log", "content", "description", "testo"),
    "process": ("processname", "process", "program", "application", "app", "comm", "unit", "service"),
    "pid": ("pid", "processid"),
    "host_ip": ("hostip", "ip", "ipaddress"),
    "tenant_id": ("tenantid",),
    "source_system": ("sourcesystem",),
    "management_group": ("mg", "managementgroup"),
    "hostname": ("hostname",),
    "collector_host_name": ("collectorhostname",),
    "type": ("type",),
}
EXPECTED = ("timestamp", "host", "facility", "severity", "message", "process", "host_ip")
METADATA = ("tenant_id", "source_system", "management_group", "hostname", "collector_host_name", "type")


@dataclass(frozen=True)
class Params:
    """Parameters of an analysis; raises ValueError where one is out of range."""

    window_minutes: int = 5
    threshold: float = 2.0
    min_events: int = 5
    use_history: bool = True
    naive_offset: str = "+00:00"
    date_order: str = "DMY"
    delimiter: str = "auto"
    #: Limits of an import, for each file; none by default. What they leave out is reported.
    max_events: int | None = None
    max_file_bytes: int | None = None
    as_of_year: int | None = None

    def __post_init__(self):
        whole = lambda v, low, high: isinstance(v, int) and not isinstance(v, bool) and low <= v <= high
        if not whole(self.window_minutes, 1, 1440):
            raise ValueError("window_minutes must be a whole number from 1 to 1440.")
        if not isinstance(self.use_history, bool):
            raise ValueError("use_history must be true or false.")
        if self.use_history and not (math.isfinite(self.threshold) and 1.1 <= self.threshold <= 100):
            raise ValueError("threshold must be from 1.1 to 100.")
        if not whole(self.min_events, 3, 100_000):
            raise ValueError("min_events must be a whole number from 3 to 100000.")
        if self.date_order not in ("DMY", "MDY"):
            raise ValueError("date_order must be DMY or MDY.")
        if self.delimiter not in ("auto", ",", ";", "\t", "|"):
            raise ValueError("delimiter must be auto, comma, semicolon, tab or pipe.")
        for name in ("max_events", "max_file_bytes"):
            if getattr(self, name) is not None and not whole(getattr(self, name), 1, 1 << 62):
                raise ValueError(f"{name} must be a positive whole number.")
        offset_seconds(self.naive_offset)

    @property
    def seconds(self) -> int:
        return self.window_minutes * 60

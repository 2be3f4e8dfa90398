"""Log spike triage as Spark jobs."""

"""Empty: the analysis is of whole data sets; no report is defined on an unbounded stream."""

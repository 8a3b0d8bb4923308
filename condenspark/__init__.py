"""Log condensation on Spark: severity, templates, patterns, spikes and summaries as DataFrame operators."""

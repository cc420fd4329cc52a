"""Log monitoring as Spark DataFrame jobs: ingest, search, alert rules, incidents, analysis."""

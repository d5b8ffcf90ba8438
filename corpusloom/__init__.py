"""corpusloom: corpus curation, scoring and auditing as composable PySpark DataFrame operators."""

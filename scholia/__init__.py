"""scholia: DataFrame operators for literature-evidence pipelines on Apache Spark."""

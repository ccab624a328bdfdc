"""locusframe: a Spark-native analytics engine for comparative genomics tables."""

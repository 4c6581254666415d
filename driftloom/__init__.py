"""driftloom: Spark-native analytics for embedding tables, condition records and training corpora."""

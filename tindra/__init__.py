"""A Spark-native analytics engine for source-traceable knowledge bases."""

"""lodestone: a Spark-native analytics engine for literature evidence."""

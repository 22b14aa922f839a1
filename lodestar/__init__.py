"""lodestar: a Spark-native vertical search and analytics engine."""

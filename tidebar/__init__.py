"""tidebar: a Spark-native analytics engine for time-ordered price bars."""

"""lodestone: a Spark-native analytics engine for content libraries and their workflows."""

"""A Spark-native engine for variant-score analytics and corpus preparation."""

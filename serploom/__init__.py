"""A Spark-native engine for ranking-factor analytics and training-data preparation."""

"""A Spark-native toolkit for document stores, retrieval and corpus analytics."""

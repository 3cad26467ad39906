"""Spark-native machining analytics."""

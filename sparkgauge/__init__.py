"""A Spark-native analytics engine for infrastructure records published as periodic snapshots."""

"""A PySpark-native engine that ranks, screens and scores cohorts of instruments."""

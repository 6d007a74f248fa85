"""PySpark-native analytics over labelled feature-by-observation tables."""

"""callmetrics: Spark-native analytics over saved records of tool-calling systems."""

"""gneiss: a PySpark-native engine for the data work around machine-learning pipelines."""

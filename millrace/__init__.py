"""millrace: a PySpark-native engine for building, cleaning and scoring text corpora."""

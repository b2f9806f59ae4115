"""quillspark: a PySpark-native engine for literature analytics and training-data preparation."""

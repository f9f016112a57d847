"""veilspark: a PySpark-native engine for finding, masking and restoring sensitive data in document tables."""

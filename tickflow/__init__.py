"""A PySpark-native engine for event-time point processes and corpus preparation."""

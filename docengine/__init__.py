"""docengine: a PySpark-native document-intelligence engine."""

"""tessera: a PySpark-native engine for project-record and corpus queries."""

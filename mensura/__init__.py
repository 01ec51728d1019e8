"""mensura: a PySpark-native engine for heterogeneous measurement reports."""

"""A PySpark-native engine for analysing long documents."""

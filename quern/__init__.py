"""quern: a PySpark-native analytics engine (relational core, merge-on-read, change replay)."""

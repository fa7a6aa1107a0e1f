"""PySpark-native sensor-fusion analytics."""

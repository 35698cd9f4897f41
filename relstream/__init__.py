"""A PySpark-native relational and event-time analytics engine."""

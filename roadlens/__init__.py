"""Drive-log and event-window analytics as PySpark DataFrame operators."""

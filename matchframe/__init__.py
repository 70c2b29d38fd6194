"""matchframe: match-log analytics as PySpark DataFrame operators."""

"""ranklens: offline ranking-log analytics as PySpark DataFrame operators."""

"""kerbside: detection-data analytics as Spark DataFrame operators."""

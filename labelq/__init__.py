"""labelq: label-quality analytics as Spark DataFrame operators."""

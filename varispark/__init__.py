"""Population-genetics analytics as Spark DataFrame plans."""

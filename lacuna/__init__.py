"""lacuna: topic-coverage analytics as PySpark DataFrame jobs."""

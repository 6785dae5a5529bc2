"""Text-recognition data work as Spark DataFrame operators."""

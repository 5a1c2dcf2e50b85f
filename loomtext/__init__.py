"""Text and table analytics written as Spark DataFrame plans."""

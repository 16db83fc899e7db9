"""loomwork: knowledge and table analytics expressed as Spark DataFrame plans."""

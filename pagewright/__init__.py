"""Web-page analytics expressed as Spark DataFrame plans."""

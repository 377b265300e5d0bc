"""Document analytics on Spark: operators as DataFrame plans."""

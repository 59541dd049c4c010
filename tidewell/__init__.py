"""Asset time-series analytics and corpus preparation as Spark DataFrame plans."""

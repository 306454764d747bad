"""meterflow: meter and sensor time-series analytics as Spark DataFrame transformations."""

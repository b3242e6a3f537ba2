"""Token-level classifier analytics on Spark: labels, joins, metrics, splits and reports as DataFrame operators."""

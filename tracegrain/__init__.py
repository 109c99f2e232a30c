"""Component-evidence analytics on Spark: kernels, joins, verdicts and build-log graphs as DataFrame plans."""

"""Notice analytics on Spark: parse, version, search, match, alert, measure."""

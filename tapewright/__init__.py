"""Trade-tick analytics on Spark: bars, features, horizon labels, two-stage shock scoring and evaluation."""

"""DataFrame operators: bars, features, labels, splits, curves, scores, metrics, anomalies."""

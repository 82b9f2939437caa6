"""Reading and writing: trades, flush files, labelled rows, thresholds, results, models."""

"""Load-event analytics over power time series, as functions from DataFrame to DataFrame."""

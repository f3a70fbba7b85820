"""Log analytics on Spark: normalise, store, query, aggregate, detect and cluster."""

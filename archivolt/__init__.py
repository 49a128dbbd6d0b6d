"""archivolt: document knowledge bases built and queried with Spark DataFrames."""

"""Web-crawl analytics as Spark DataFrame, SQL and streaming jobs."""

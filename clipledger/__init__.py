"""Set-based Spark jobs over media-request logs, catalogues and event streams."""

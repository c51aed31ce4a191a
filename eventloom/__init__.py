"""eventloom: event analytics and text-corpus preparation as Spark DataFrame jobs."""

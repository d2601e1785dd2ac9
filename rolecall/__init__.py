"""rolecall: job-posting research and eligibility analysis as Spark DataFrame jobs."""

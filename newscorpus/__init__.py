"""Building and curating article corpora from crawled pages, as Spark jobs."""

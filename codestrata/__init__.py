"""Code-corpus analytics on Spark: many repositories, one distributed job."""

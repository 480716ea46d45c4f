"""cvloom: document intelligence and candidate search, Spark first."""

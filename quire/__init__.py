"""quire: document-compliance analytics over corpora as Spark jobs."""

"""doclens: document intelligence and retrieval as Spark DataFrame transformations."""

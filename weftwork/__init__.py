"""weftwork: graph, provenance and corpus analytics expressed as Spark plans."""

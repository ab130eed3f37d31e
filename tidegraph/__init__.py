"""tidegraph: temporal knowledge-graph and corpus analytics expressed as Spark plans."""

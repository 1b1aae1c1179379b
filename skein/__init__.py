"""skein: property-graph, evidence and retrieval analytics as Spark DataFrame jobs."""

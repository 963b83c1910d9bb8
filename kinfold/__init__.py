"""Entity resolution, lineage and record flattening as Spark jobs."""

"""whylake: decision provenance for fleets of code repositories, as Spark jobs."""

"""coppice: Spark jobs over trees, references, versions and logs held as tables."""

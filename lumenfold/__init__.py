"""Image-corpus, label and raster analytics as Spark DataFrame jobs."""

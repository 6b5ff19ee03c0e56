"""voxweave: dense RGB-D mapping and surface registration as Spark DataFrame jobs."""

__version__ = "0.1.0"

"""weftline: corpus building, curation, packing and scoring as Spark DataFrame plans."""

__version__ = "0.1.0"

"""corvane: document and source-code analytics with hybrid retrieval, expressed as Spark plans."""

__version__ = "0.1.0"

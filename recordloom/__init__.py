"""recordloom: a Spark-first engine that turns messy multi-source records into fused, checked, projected profiles."""

__version__ = "0.1.0"

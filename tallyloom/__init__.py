"""tallyloom: content-provenance analytics on Spark, built from bag algebra over fingerprints."""

__version__ = "0.1.0"

"""A PySpark analytics engine for document pages, image regions and processing telemetry."""

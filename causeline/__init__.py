"""causeline: event causality from timestamped logs, as PySpark DataFrame operators."""

__version__ = "0.1.0"

"""driftwarden: DataFrame operators for classifier-drift and anomaly analytics on Spark."""

__version__ = "0.1.0"

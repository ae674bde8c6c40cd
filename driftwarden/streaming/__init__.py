"""Continuous forms of the traffic windows and of the drift verdict."""
from driftwarden.streaming.traffic import TrafficLedger, stream_traffic, write_windows  # noqa: F401
from driftwarden.streaming.drift import DriftMonitor  # noqa: F401
from driftwarden.streaming.state import WindowedDrift  # noqa: F401

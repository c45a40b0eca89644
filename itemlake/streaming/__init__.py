"""Documents and status events that arrive over time."""

"""streaming of the keyed-table engine."""

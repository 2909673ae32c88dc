"""sources of the keyed-table engine."""

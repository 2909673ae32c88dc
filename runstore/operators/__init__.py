"""operators of the keyed-table engine."""

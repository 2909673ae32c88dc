"""functions of the keyed-table engine."""

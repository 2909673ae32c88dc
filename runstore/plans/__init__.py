"""plans of the keyed-table engine."""

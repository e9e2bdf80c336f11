"""Frame laws: what a record's channels are at a frame, as columns."""

"""Table readers and sinks."""

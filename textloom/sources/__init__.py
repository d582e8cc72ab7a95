"""Table, text, JSON and CSV sources and sinks."""

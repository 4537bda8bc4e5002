"""Sources and sinks: file listings and versioned tables."""

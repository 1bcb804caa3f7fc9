"""SQL analytics over versioned tables and ordered event logs, on DataFrames and Structured Streaming."""

"""Table sources: parquet scans, the driver-table adapter and CSV readers."""

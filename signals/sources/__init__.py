"""Sources and sinks: driver-table adapter, CSV/Parquet tables, score and report writers."""

"""Sources and sinks: parquet tables, CSV files, previews, presets."""

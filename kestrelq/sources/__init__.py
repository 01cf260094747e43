"""Sources and sinks: CSV with inference, the columnar file, and tables by formula."""

"""Reading extracts into staging, and storing tables as published snapshots."""

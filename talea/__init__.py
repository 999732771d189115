"""talea: ledger, telemetry and data-quality analytics on PySpark DataFrames."""

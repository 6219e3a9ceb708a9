"""Where rows come from and go to: wire messages, tables, the Parquet store."""

"""Job plans: domain views over the driver tables, end-to-end jobs and the query catalogue."""

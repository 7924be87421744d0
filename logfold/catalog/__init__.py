"""The queries run over the driver's tables, and the SQL they must agree with."""

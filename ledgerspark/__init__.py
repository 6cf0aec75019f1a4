"""ledgerspark: financial-document extraction and reconciliation as Spark jobs."""

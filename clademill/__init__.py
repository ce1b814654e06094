"""clademill: sequence, alignment and record analytics as composable Spark DataFrame operators."""

"""copse: attributed graphs from forests of syntax trees, and corpus operators, on PySpark."""

"""flowtrace: transaction forensics as PySpark DataFrame transformations."""

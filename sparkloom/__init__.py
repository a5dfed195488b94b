"""sparkloom: evidence search, profiling, versioning and training-data operators written for Spark."""

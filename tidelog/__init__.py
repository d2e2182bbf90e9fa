"""tidelog: Spark operators for observation logs, in which many entities repeat payloads over time."""

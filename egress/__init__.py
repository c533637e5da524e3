"""egress: network-resilience and evacuation analytics on PySpark."""

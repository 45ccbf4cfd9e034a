"""Network-traffic threat analytics on Spark: packets in, alerts and reports out."""

"""Packet, container and signal analytics on PySpark."""

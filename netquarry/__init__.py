"""Packet-capture analytics on Spark."""

"""Peer-relative analytics expressed as Spark DataFrame plans."""

"""Collider-event analytics expressed as Spark DataFrame transformations."""

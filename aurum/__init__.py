"""Aurum: a Spark engine that masters records from many sources into golden entities."""

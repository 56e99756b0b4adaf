"""Encoded chunks: schema, building from rows, reading and writing."""

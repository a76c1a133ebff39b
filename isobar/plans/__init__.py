"""Bindings of the supplied tables, registered queries and analyses."""

"""Foliomill: catalog, text and corpus analytics as Spark plans."""
